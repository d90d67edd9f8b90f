import base64
import hashlib

import numpy as np

from orbweave.llm import chat, common, warc


def test_template_round_trip():
    turns = [("user", r"\### Assistant: </turn> ok"), ("assistant", "<|end|><|turn|>\\<\\|\\\\ <<|"), ("sys<|text|>", ""), ("assistant", "<")]
    formatted, spans = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [turns[1][1], "<"]


def test_reply_trees_rank_branches(spark):
    """Also with a circle, a message that replies into it, and one that replies to itself."""
    nodes = [("t", "a", None, 1.0), ("t", "b", "a", 1.0), ("t", "c", "a", 5.0), ("t", "d", "b", 9.0), ("t", "e", "c", None), ("s", "x", "gone", 0.0)]
    nodes += [("s", "p", "q", 0.0), ("s", "q", "r", 0.0), ("s", "r", "p", 0.0), ("s", "into", "p", 9.0), ("s", "self", "self", 9.0)]
    nodes = spark.createDataFrame([(*n, 1, "x") for n in nodes], "tree string, node string, parent string, score double, leaf int, up string")
    every = chat.reply_paths(nodes, branches=None).collect()
    path = lambda leaf: [r.node for r in sorted(every, key=lambda r: -r.dist) if r.leaf == leaf]
    assert path("d") == ["a", "b", "d"] and path("e") == ["a", "c", "e"] and path("x") == ["x"]
    assert {(r.leaf, r.rank) for r in every} == {("d", 1), ("e", 2), ("x", 1)}
    assert {r.leaf for r in chat.reply_paths(nodes).collect()} == {"d", "x"}


def test_null_ids_and_ids_that_spell_null(spark):
    rows = [(c, k, role, f"{c} {k}") for c in (None, "null", "=null", "a:1", "a", "") for k, role in enumerate(("user", "assistant"))]
    turns = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")
    found = {r.conv: chat.parse_turns(r.formatted) for r in chat.format_conversations(turns).collect()}
    assert found == {c: [("user", f"{c} 0"), ("assistant", f"{c} 1")] for c in (None, "null", "=null", "a:1", "a", "")}


def test_repeated_nodes_and_a_comb(spark):
    """A node that stands eight times; a path of 60 with a leaf on each node, of which only the best is listed."""
    nodes = [("t", "r", None, 0.0)] + [("t", "a", "r", float(k)) for k in range(8)] + [("t", "b", "a", 1.0), (None, None, "a", 9.0)]
    comb = [("c", f"n{k:02}", f"n{k - 1:02}" if k else None, 1.0) for k in range(60)] + [("c", f"x{k:02}", f"n{k:02}", 0.5 if k != 30 else 100.0) for k in range(60)]
    table = spark.createDataFrame(nodes + comb, "tree string, node string, parent string, score double")
    paths = chat.reply_paths(table)
    rows = sorted((r.tree, -r.dist, r.node) for r in paths.collect())
    assert rows == [("c", k - 31, f"n{k:02}") for k in range(31)] + [("c", 0, "x30")] + [("t", -2, "r"), ("t", -1, "a"), ("t", 0, "b")]
    assert chat.reply_paths(table, branches=2).filter("rank = 2 AND tree = 'c'").agg({"dist": "max"}).first()[0] == 60
    texts = spark.createDataFrame([("r", "user", "1"), ("a", "assistant", "2"), ("a", "assistant", "2"), ("a", "assistant", "3"), ("b", None, None)], "node string, role string, text string")
    (made,) = chat.format_paths(paths.filter("tree = 't'"), texts).collect()
    assert chat.parse_turns(made.formatted) == [("user", "1"), ("assistant", "2"), ("", "")]


def test_very_long_and_clashing_conversations(spark):
    rows = [(1, 0, "user", "x" * 300_000, 1, "a"), (1, 1, "assistant", "<|end|>" * 40_000, 2, "b")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, node int, tree string")
    row = chat.conversation_digest(chat.format_conversations(turns)).first()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, 280_000, hashlib.sha256(rows[1][3].encode()).hexdigest())


def test_conversations_digest(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"text {k}") for k in range(70)] + [(2, 0, None, None), (2, 0, "assistant", "b"), (None, 1, "user", "z"), (3, 1, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = {r.conv_id: r for r in chat.conversation_digest(chat.format_conversations(turns)).collect()}
    by = {i: sorted((r for r in rows if r[0] == i), key=lambda r: (r[1], r[2] or "")) for i in (1, 2, 3, None)}
    for i, own in by.items():
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        assert (found[i].n_turns, found[i].turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (found[i].loss_chars, found[i].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digest(chat.format_conversations(turns.limit(0))).count() == 0


def test_archives_round_trip(spark, tmp_path):
    big = "é" * 1_500_000
    rows = [(1, "u1", "same"), (5, "u\r\n5%", "same"), (3, None, "same"), (4, "u4", None), (2, "u2", ""), (6, "u6", big), (None, "n", "same"), (7, "u7", "<p>\r\n\r\n</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS frame", "'x' AS bundle", "'y' AS sha1")
    index, records = warc.archive(pages)
    found = {r.page_id: r for r in records.collect()}
    assert len(found) == len(rows)
    for i, url, html in rows:
        payload = (html or "").encode()
        r = found[i]
        assert (r.url, r.payload_bytes, r.payload_digest) == (url or "", len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
    assert {i: r.refers_to for i, r in found.items()} == {1: 5, 5: None, 3: 5, 4: None, 2: 4, 6: None, None: 5, 7: None}
    assert {r.record_type for r in records.filter("refers_to IS NULL").collect()} == {"response"}
    place = index.filter("page_id = 7").first()
    fields, block = warc.read_record(place.bundle, place.frame, place.offset)
    assert fields["WARC-Target-URI"] == "u7" and block.endswith(b"<p>\r\n\r\n</p>")
    assert warc.archive(pages.limit(0))[1].count() == 0


def test_short_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "a", "same"), (2, "b", "same")], "page_id bigint, url string, html string")
    assert {r.record_type for r in warc.archive(pages, min_bytes=5)[1].collect()} == {"response"}


def test_copies_of_remote_files_are_shared_and_bounded(tmp_path, monkeypatch):
    """A store without local paths, played by file URIs."""
    written = common.write_arrays(f"file://{tmp_path}/store", {f"a{i}": np.arange(1000, dtype=np.int64) + i for i in range(8)})
    monkeypatch.setenv("SPARK_LOCAL_DIRS", f"{tmp_path}/executor,{tmp_path}/other")
    monkeypatch.setattr(common, "CACHE_BYTES", 3 * 8000)
    monkeypatch.setattr(common, "local_path", lambda uri: None)
    folder = tmp_path / "executor" / "orbweave-copies"
    workers = common._Copies(), common._Copies()
    for name, uri, dtype, n in [*written, *written]:
        first, second = (w.mapped(uri, dtype, n) for w in workers)
        assert first[0] == second[0] == int(name[1:]) and len(first) == 1000
        assert first.filename == second.filename and len(list(folder.iterdir())) <= 3
        assert all(sum(a.nbytes for a in w.open.values()) <= common.CACHE_BYTES for w in workers)
    monkeypatch.setattr(common, "CACHE_BYTES", 10)  # less than one file
    name, uri, dtype, n = written[0]
    assert common._Copies().mapped(uri, dtype, n)[5] == 5 and len(list(folder.iterdir())) == 1


def test_shared_payloads_without_a_shuffle_of_pages(spark):
    """A third of the pages share one payload; ids are texts, one of them null; payloads under min_bytes are responses."""
    import base64
    import hashlib

    rows = [(f"p{i:03d}", "u", "<p>gone</p>" if i % 3 == 0 else "" if i % 10 == 1 else f"<p>{i // 2}</p>", "x") for i in range(300)] + [(None, None, "<p>gone</p>", "y")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, refers_to string").repartition(5)
    last = {}
    for name, _, html, _ in rows:
        last[html] = max(last.get(html, ""), name or "")
    for low in (0, 1):
        index, records = warc.archive(pages, min_bytes=low)
        got = {r.page_id: (r.payload_bytes, r.payload_digest, r.refers_to) for r in records.collect()}
        digest = lambda html: base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert got == {n: (len(h), digest(h), None if n == last[h] or len(h) < low else last[h]) for n, _, h, _ in rows}
        assert index.count() == len(rows)
    plan = warc.write_bundles(pages.filter("page_id > 'p'"), common.fresh_dir(spark, "warc"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
