import pytest
import tokenizers
from pyspark.sql import functions as F
from test_duplicates import groups, kept_words
from test_models import exhaustive

import corpus_pipeline
from orbweave.llm.common import table, without_ids

STAGES = dict(corpus_pipeline.STAGES)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_stages_keep_what_brute_force_keeps(spark, sf_dir):
    """Each stage on what its predecessor kept, at its own parameters."""
    docs = table(spark, sf_dir, "documents")
    toxic = {r.doc_id for r in table(spark, sf_dir, "labels").filter("toxic = 1").collect()}
    clean = STAGES["toxicity"](spark, docs, sf_dir).cache()
    assert clean.columns == docs.columns and clean.join(docs, ["doc_id", "text"]).count() == clean.count()
    gone = {i for i, _ in rows_of(docs)} - {i for i, _ in rows_of(clean)}
    labelled = {r.doc_id for r in table(spark, sf_dir, "labels").collect()}
    assert len(gone & labelled - toxic) <= 1 and len(toxic - gone) <= 1  # at most one training label on either side

    single = STAGES["near_duplicates"](spark, clean, sf_dir).cache()
    assert single.columns == docs.columns
    least = groups(rows_of(clean), 5, 80)
    assert sorted(rows_of(single)) == sorted((i, t) for i, t in rows_of(clean) if least[i][1] == i)

    cut = STAGES["substring_duplicates"](spark, single, sf_dir).cache()
    assert cut.columns == docs.columns
    expected = kept_words(rows_of(single), 50)
    assert {i: kept_words([(i, t)], 10**9)[i][2] for i, t in rows_of(cut)} == {i: e[2] for i, e in expected.items()}

    left = STAGES["decontamination"](spark, cut, sf_dir).cache()
    assert left.columns == docs.columns
    leaks = {d for d, _ in exhaustive(rows_of(cut), [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()])}
    assert sorted(rows_of(left)) == sorted(r for r in rows_of(cut) if r[0] not in leaks)

    library, texts = tokenizers.Tokenizer.from_file(corpus_pipeline.tokenizer_path("word_bpe_49k.json")), dict(rows_of(left))
    library.no_truncation(), library.no_padding()
    coded = STAGES["bpe"](spark, left, sf_dir).collect()
    assert len(coded) == len(texts)
    for r in coded:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.token_ids, r.n_tokens, r.decoded) == (ids, len(ids), library.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("stage", ["toxicity", "near_duplicates", "substring_duplicates", "decontamination", "bpe"])
def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs, stage):
    """No row is toxic, near another, long enough to repeat, or a leak; two rows repeat one id."""
    docs = odd_docs.drop("score").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(""), "n_chars": F.lit(0).cast("bigint")})
    out = STAGES[stage](spark, docs, sf_dir)
    assert out.count() == docs.count()
    assert STAGES[stage](spark, docs.limit(0), sf_dir).count() == 0


def test_dropping_ids_keeps_the_rest(odd_docs, spark):
    gone = spark.createDataFrame([(8,), (2,), (None,)], "x bigint")
    left = without_ids(odd_docs, "doc_id", gone)
    assert left.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 9]


def test_hashes_of_integer_ids_are_a_permutation(spark):
    """Each step of the hash taken back gives the id again, so no two ids share one."""
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    word = (1 << 64) - 1
    back = lambda x, p: x * pow(p, -1, 1 << 64) & word
    turn = lambda x, n: (x >> n | x << 64 - n) & word
    ids = [0, 1, -1, 50, 2**63 - 1, -(2**63), *(i * 7919**4 for i in range(-900, 900))]
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", F.xxhash64("id").alias("h")).collect()
    for r in rows:
        x = r.h & word
        x = back(x ^ x >> 32, p3)
        x = back(x ^ x >> 29 ^ x >> 58, p2)
        x ^= x >> 33
        x = turn(back(x - p4, p1), 27) ^ (42 + p5 + 8)
        assert back(turn(back(x, p1), 31), p2) == r.id & word


def test_dropping_ids_of_another_integer_type(odd_docs, spark):
    gone = spark.createDataFrame([(8,), (2,)], "x int")
    assert without_ids(odd_docs, "doc_id", gone).count() == odd_docs.count() - 3
