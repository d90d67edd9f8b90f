import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from orbweave.llm import oracles, prefix_trie, queries
from orbweave.llm.common import table

COLUMNS = "conv_id bigint, turn bigint, role string, text string, depth int, p1 string, words int, tail int"


def ordered(rows):
    said = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, said(role or "", text or ""), role or "", text or ""))
    return {c: [r[3:] for r in sorted(own)] for c, own in convs.items()}


def trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    below = {}
    for key in sorted(members, key=len, reverse=True):
        saved = (len(members[key]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1] if key else ""))
        leaves = 1 if not children[key] else 0
        for k in children[key]:
            saved, leaves = saved + below[k][0], leaves + below[k][1]
        below[key] = (saved, leaves)
    out = []
    for key, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(key))))
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), len(children[key]), below[key][1], below[key][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def rows_of(seed):
    rng = random.Random(seed)
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", None, "a:"]), rng.choice(["hi", "hi there", "", None, " \t", "1:", "日本 語"])) for c in range(150) for _ in range(rng.randint(1, 5))]
    same = [(f"turn {k} of it") for k in range(120)]
    rows += [(c, k, "user", t) for c in (1000, 1001, 5000, 9999) for k, t in enumerate(same[: 120 - c % 7])]  # as long as several ranges
    rows += [(20_000 + c, 0, "user", "the same") for c in range(9000)]  # ends in many parts
    return rows + [(None, 1, "user", "lost"), (7, 3, "user", "twice"), (7, 3, "user", "twice")]


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("most_cells", [1 << 30, 40, 1])
def test_tries_equal_brute_force(spark, monkeypatch, most_cells):
    """Also where the sketch is so small that it proves little or nothing."""
    monkeypatch.setattr(prefix_trie, "MOST_CELLS", most_cells)
    monkeypatch.setattr(prefix_trie, "BLOCK_OF_DEPTHS", 4)
    rows = rows_of(most_cells)
    turns = prefix_trie.turn_digests(spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], COLUMNS))
    convs = ordered(rows)
    assert found(prefix_trie.prefix_trie(turns)) == trie(convs)
    more = spark.createDataFrame([(-5,), (7,), (None,)], "id bigint")
    if most_cells == 40:
        assert found(prefix_trie.prefix_trie(turns, more)) == trie(convs | {-5: []})
        assert found(prefix_trie.prefix_trie(*prefix_trie.with_common_starts(turns))) == trie(rebuilt(convs))


def test_one_conversation_over_many_ranges(spark):
    rows = [(3, k % 50, "user", f"{k % 7}") for k in range(2000)] + [(4, 0, "user", "x")]
    turns = prefix_trie.turn_digests(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    places = sorted((r.conv_id, r.depth, r.is_end) for r in prefix_trie.prefixes(turns).collect())
    assert places == [(3, d, d == 2000) for d in range(1, 2001)] + [(4, 1, True)]
    assert found(prefix_trie.prefix_trie(turns)) == trie(ordered(rows))


def test_no_conversations(spark):
    turns = prefix_trie.turn_digests(spark.createDataFrame([(None, None, None, None)], "conv_id bigint, turn bigint, role string, text string"))
    assert prefix_trie.prefix_trie(*prefix_trie.with_common_starts(turns)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    expected = sorted(con.sql(oracles.PREFIX_TRIE).fetchall(), key=str)
    assert found(queries.op12_prefix_trie(spark, sf_dir)) == expected
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert expected == trie(rebuilt(ordered(rows)))
