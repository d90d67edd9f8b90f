import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orbweave.llm import queries, token_store
from orbweave.llm.common import mix, table

WORDS = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts, end=2):
    from tokenizers import Tokenizer

    return [e.ids + [end] for e in Tokenizer.from_file(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_by_key_equal_the_library(spark, sf_dir):
    docs = sorted(table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    expected, start = [], 0
    for r, ids in zip(docs, library_ids([r.text for r in docs]), strict=True):
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op11_token_store(spark, sf_dir).collect()) == expected


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_perfect_hash_has_no_gaps(n):
    one, two = mix(np.arange(n, dtype=np.uint64)), mix(np.arange(n, dtype=np.uint64) + np.uint64(1 << 40))
    own = token_store.PerfectHash.of(one, two)
    assert sorted(own.numbers(one, two).tolist()) == list(range(n))
    other = own.numbers(two, one)
    assert ((other >= -1) & (other < max(n, 1))).all()


def test_repeated_null_and_unknown_keys(spark, odd_docs, no_docs):
    """A key of a third of the rows spreads over the shards; texts with ids over 16 bits."""
    many = odd_docs.select("doc_id", "text", "n", F.lit(1).alias("key"))
    many = many.unionAll(spark.range(400).select(F.lit(5).cast("bigint"), F.concat(F.lit("word "), F.col("id").cast("string")), F.lit(1), F.lit(2)))
    own = token_store.write_store(many, path=WORDS, end_id=70_000)
    assert own.width == 4 and own.shards.filter("n_docs > 0").count() > 2
    rows = token_store.as_numbers(token_store.read_documents(own, many.select("doc_id"))).collect()
    given = many.select("doc_id", "text").collect()
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in rows)
    assert found == sorted((r.doc_id is not None, r.doc_id or 0, ids) for r, ids in zip(given, library_ids([r.text for r in given], 70_000), strict=True))
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.concatenate([[0], np.cumsum([r.n_tokens for r in ordered])])[:-1].tolist()
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))
    asked = spark.createDataFrame([(9,), (9,), (77,), (None,)], "wanted int")
    assert {r.doc_id for r in token_store.read_documents(own, asked).collect()} == {9, None}
    empty = token_store.write_store(no_docs, path=WORDS)
    assert token_store.read_documents(empty, asked).count() == 0


def test_string_keys(spark):
    docs = spark.createDataFrame([(f"k{i}", f"text number {i}") for i in range(300)], "name string, text string")
    own = token_store.write_store(docs, "name", path=WORDS)
    assert own.width == 2
    rows = {r.name: r.ids for r in token_store.as_numbers(token_store.read_documents(own, docs.select("name").limit(50).unionAll(spark.createDataFrame([("none",)], "n string")))).collect()}
    assert len(rows) == 50 and all(ids == library_ids([f"text number {k[1:]}"])[0][:-1] for k, ids in rows.items())
