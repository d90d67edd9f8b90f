import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbweave.llm import fingerprint, minhash, substring
from orbweave.llm.common import table
from orbweave.llm.graph import components


def shingles(text, n):
    words = [w.lower() if w.isascii() else w for w in (text or "").encode().decode().split()]
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def groups(rows, n, percent):
    """Brute force: every pair."""
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, shingle=3, percent=85).collect()}
    assert found == groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 3, 85)


def test_chains_of_edits_keep_every_link(spark):
    """Copies whose edits drift apart: stars alone leave them in several components."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, shingle=3, percent=85).collect()}
    assert found == groups(rows, 3, 85)


def one_bucket(n, seed):
    """Sets of many sizes that share fifty values, and pairs among them that are just alike enough or just not."""
    rng = np.random.default_rng(seed)
    common = rng.integers(1, 1 << 62, 50, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(1, 1 << 62, int(np.exp(rng.uniform(4, 7))), dtype=np.uint64)])) for _ in range(n)]
    for k in range(0, 40, 2):
        own = sets[k]
        gone = int(len(own) * (0.08 + 0.0002 * k))
        sets[k + 1] = np.unique(np.concatenate([own[gone:], rng.integers(1, 1 << 62, gone if k % 4 else 0, dtype=np.uint64)]))
    return sets


def alike(a, b, percent):
    both = len(np.intersect1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def test_a_bucket_of_unlinked_classes(spark, monkeypatch):
    """5,000 classes: sets that can have no link are not compared, and none of the links is lost."""
    sets = one_bucket(5000, 1)
    links = {(k, k + 1) for k in range(0, 40, 2) if alike(sets[k], sets[k + 1], 85)}
    assert 5 < len(links) < 20
    rows = [(k, len(own), 1, own.tobytes()) for k, own in enumerate(sets)]
    table = spark.createDataFrame(rows, "node bigint, n bigint, bucket bigint, hashes binary").withColumn("node", F.col("node").cast("decimal(38,0)"))
    hubs = table.groupBy("bucket").agg(F.min("node").alias("u"), F.count("*").alias("c"), F.lit(1).alias("members"))
    none = spark.createDataFrame([], "u decimal(38,0), v decimal(38,0)")
    for block in (1 << 18, 1 << 15):
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
        found = minhash._bucket_links(table.select("node", "n", "bucket"), hubs, none, table.select("node", "hashes"), 85)
        assert {tuple(sorted((int(r.u), int(r.v)))) for r in found.collect()} == links
    frame = table.select("node", "hashes").withColumn("comp", F.col("node").cast("bigint")).toPandas()
    calls, real = [], minhash._common
    monkeypatch.setattr(minhash, "_common", lambda own, *rest: calls.append(len(own)) or real(own, *rest))
    found = minhash._block_links(frame, frame, 85)
    assert {tuple(sorted(map(int, x))) for x in found.itertuples(index=False)} == links
    # every set shares its own rare values with itself; against others it is compared where it may be linked
    calls.clear()
    minhash._block_links(frame[40:2500], frame[2500:], 85)
    assert len(calls) < 25


@pytest.mark.parametrize("percent", [1, 50, 80, 85, 100])
def test_block_links_equal_brute_force(percent):
    import pandas as pd

    rng = np.random.default_rng(percent)
    sets = [np.unique(rng.choice(400, int(rng.integers(1, 60)))).astype(np.uint64) + np.uint64(7) for _ in range(120)]
    sets += [np.unique(np.concatenate([s[: len(s) - k % 4], rng.integers(500, 900, k % 3).astype(np.uint64)])) for k, s in enumerate(sets) if len(s) > 4]
    frame = pd.DataFrame({"node": range(len(sets)), "comp": range(len(sets)), "hashes": [s.tobytes() for s in sets]})
    found = {(x.u, x.v) for x in minhash._block_links(frame[::2], frame, percent).itertuples()}
    assert found == {(u, v) for u in range(0, len(sets), 2) for v in range(len(sets)) if u != v and alike(sets[u], sets[v], percent)}


def test_near_duplicates_on_odd_and_empty_tables(odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.kept and r.component_id == r.doc_id for r in rows)
    assert {r.n_shingles for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert minhash.near_duplicates(no_docs).count() == 0


def test_rows_of_one_id_are_linked_by_their_own_texts(spark):
    p, q = [f"p{i}" for i in range(60)], [f"q{i}" for i in range(60)]
    rows = [(5, p), (5, q), (7, [*p[:-1], "x"]), (9, [*q[:-1], "y"])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()} == {(5, 5, True), (7, 5, False), (9, 5, False)}
    names = spark.createDataFrame([(f"n{i}", " ".join(w)) for i, w in rows], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(names).collect()} == {("n5", "n5"), ("n7", "n5"), ("n9", "n5")}


def test_buckets_that_chain_are_compared_one_by_one(spark, monkeypatch):
    """Texts on a ring, each alike enough to its neighbours to share buckets with them but not to be
    linked: what is compared grows with the texts, not with their square."""
    n, step, size = 1500, 8, 40
    ring = [f"w{i}" for i in range(n * step)]
    rows = [(i, " ".join((ring * 2)[i * step : i * step + size])) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    compared = []
    real = minhash._bucket_links

    def counted(buckets, hubs, *rest):
        compared.append(hubs.filter("c > 2").selectExpr("sum(c * c) AS pairs").first()["pairs"] or 0)
        return real(buckets, hubs, *rest)

    monkeypatch.setattr(minhash, "_bucket_links", counted)
    found = minhash.near_duplicates(docs, shingle=3, percent=85).collect()
    assert all(r.kept for r in found) and len(found) == n
    assert compared[0] < 20 * n


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 160)}


def kept_words(rows, size):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            window = tuple(words[k : k + size])
            if window in seen:
                gone[k : k + size] = [True] * size
            seen.add(window)
        out[i] = (len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())
    return out


def test_substrings_equal_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for size in (20, 7):
        found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.duplicate_digest(docs, min_words=size).collect()}
        assert found == kept_words(rows, size)


def test_substrings_of_repetitive_texts(spark):
    rng = random.Random(1)
    passages = [[f"p{k}{i}" for i in range(rng.randint(3, 25))] for k in range(8)]
    rows = [(i, " ".join(w for _ in range(6) for w in rng.choice(passages))) for i in range(60)] + [(60, "a " * 300), (61, "b a " * 200), (62, None), (63, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for size in (2, 5, 20):
        found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.duplicate_digest(docs, min_words=size).collect()}
        assert found == kept_words(rows, size)
    cut = {r.doc_id: r.text for r in substring.without_duplicates(docs, min_words=5).collect()}
    digest = kept_words(rows, 5)
    assert all(hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() == digest[i][2] for i, t in cut.items())
    assert cut[0] == rows[0][1] or digest[0][1]


def test_sequences_that_share_one_hash_are_told_apart(spark, monkeypatch):
    """With a first hash of three bits, the second one decides."""
    real = substring.Parser.anchors

    def coarse(self, words):
        at, keys, start, own = real(self, words)
        few = np.uint64(0xE000000000000000)
        return at, keys & few, start, own & few

    rng = random.Random(9)
    passages = [" ".join(f"p{k}x{i}" for i in range(9)) for k in range(12)]
    rows = [(i, f"a{i} b{i} {rng.choice(passages)} c{i} {rng.choice(passages)} d{i}") for i in range(30)]
    index_of = substring.Parser(5)
    monkeypatch.setattr(substring.Parser, "anchors", coarse)
    texts = pa.array([t for _, t in rows])
    keys, ids, words = index_of.places(np.arange(30), texts)
    firsts = substring._firsts(keys.one, keys.two, ids, words, np.ones(len(keys), np.int64))
    assert len(set(firsts[0].tolist())) <= 8 < len(set(zip(firsts[0].tolist(), firsts[1].tolist(), strict=True))) == len(firsts[0])
    twice = firsts[4] > 1
    index = substring.Index(*(x[twice] for x in firsts[:4]))
    found, doc, word = index.first(keys)
    place = {(a, b): (c, d) for a, b, c, d, t in zip(*(x.tolist() for x in firsts[:4]), twice.tolist(), strict=True) if t}
    for a, b, f, d, w in zip(keys.one.tolist(), keys.two.tolist(), found.tolist(), doc.tolist(), word.tolist(), strict=True):
        assert f == ((a, b) in place) and (not f or place[a, b] == (d, w))


def test_substrings_on_odd_and_empty_tables(odd_docs, no_docs):
    assert substring.duplicate_digest(odd_docs, min_words=20).count() == odd_docs.count()
    assert substring.without_duplicates(odd_docs).columns == odd_docs.columns
    assert substring.duplicate_digest(no_docs).count() == 0


def test_blocks_answer_only_what_chunks_ask(spark, sf_dir, monkeypatch):
    """Many small chunks and blocks: an answer goes to the chunks that ask for its key and holds
    nothing else, whole tables come out, and each chunk is one file that three jobs read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = docs.repartition(12)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 30_000)
    found = substring.find_duplicates(docs, min_words=7)
    assert found.chunks.count() > 8 and found.parts == 2 * found.chunks.count()
    keys, places, size = {}, {}, 0
    for r in found.chunks.collect():
        for part in substring.read_chunk(found.folder, r.chunk):
            size += part.num_rows
            own, ids, words = found.parser.places(part.column(4).to_numpy(), part.column(3))
            for *k, d, w in zip(own.one.tolist(), own.two.tolist(), ids.tolist(), words.tolist(), strict=True):
                keys.setdefault(r.chunk, set()).add(tuple(k))
                places.setdefault(tuple(k), []).append((d, w))
    assert size == len(rows)
    twice = {k for k, v in places.items() if len(v) > 1}
    got = {}
    for r in found.answers[0].collect():
        one, two, doc, word = (np.frombuffer(x, kind).tolist() for x, kind in zip(r[1:], substring._ANSWER.values(), strict=True))
        for a, b, d, w in zip(one, two, doc, word, strict=True):
            assert (d, w) == min(places[a, b])
            got.setdefault(r.chunk, []).append((a, b))
    assert {c: sorted(k) for c, k in got.items()} == {c: sorted(k & twice) for c, k in keys.items() if k & twice}
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.duplicate_digest(docs, min_words=7).collect()}
    assert out == kept_words(rows, 7)
    plan = substring.without_duplicates(docs, min_words=7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # of answers: no texts are shuffled


def test_sketches_merge_and_estimate():
    words = [f"w{i}" for i in range(6000)]
    a, b, ab = fingerprint.sketch_texts(pa.array([" ".join(words[:4000]), " ".join(words[2000:]), " ".join(words)]))
    assert (fingerprint.merge(a, b) == ab).all()
    assert abs(fingerprint.resemblance(a, b) - 1 / 3) < 0.15
    assert abs(fingerprint.containment(a, ab) - 1) < 0.3
    assert abs(fingerprint.distinct_shingles(ab) / 5996 - 1) < 0.3
    assert (fingerprint.from_string(fingerprint.to_string(a)) == a).all()


def test_resemblance_is_near_the_exact_one(spark, sf_dir):
    """Against the whole shingle sets, made without the module: on average within 0.03, for
    sets that fit into a sketch exactly."""
    texts = [r.text for r in table(spark, sf_dir, "documents").select("text").collect()]
    pairs = [(t, t[: len(t) * k // 8] + u[: len(u) // 3]) for k, (t, u) in enumerate(zip(texts, texts[1:], strict=False), 1) for k in (k % 8 + 1,)]
    off = []
    for a, b in pairs:
        x, y = shingles(a, 5), shingles(b, 5)
        exact = len(x & y) / len(x | y) if x and y else float(not x and not y)
        found = fingerprint.resemblance(*fingerprint.sketch_texts(pa.array([a, b])))
        off.append(abs(found - exact))
        if len(x | y) <= fingerprint.K:
            assert found == pytest.approx(exact)
    assert np.mean(off) < 0.03 and max(off) < 0.2


def test_fingerprints_of_edits(spark, sf_dir, odd_docs, no_docs):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    texts = dict(docs.collect())
    ids = sorted(texts)
    rows = {r.doc_id: r for r in fingerprint.fingerprint_edits(docs).collect()}
    for i, after in zip(ids, ids[1:] + ids[:1]):
        text, q = texts[i], len(texts[i]) // 4
        edited = text[: len(text) - q] + texts[after][:q]
        a, b, c = fingerprint.sketch_texts(pa.array([text, edited, texts[after]]))
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.to_string(a), fingerprint.to_string(b))
        assert (r.near_edited, r.near_next) == (fingerprint.resemblance(a, b), fingerprint.resemblance(a, c))
    assert len(rows) == len(ids)
    names = docs.selectExpr("concat('n', lpad(doc_id, 9, '0')) AS doc_id", "text").union(spark.createDataFrame([(None, "no id")], "doc_id string, text string"))
    named = {r.doc_id: r for r in fingerprint.fingerprint_edits(names).collect()}
    assert all(named[f"n{i:09d}"].edited_sha256 == rows[i].edited_sha256 for i in ids[:-1]) and len(named) == len(ids) + 1
    assert named[None].near_next == fingerprint.resemblance(*fingerprint.sketch_texts(pa.array(["no id", texts[ids[0]]])))
    odd = fingerprint.fingerprint_edits(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    assert len({r.fingerprint for r in odd if r.doc_id == 8}) == 1
    assert fingerprint.fingerprint_edits(no_docs).count() == 0
    assert np.isfinite([r.near_next for r in odd]).all()
