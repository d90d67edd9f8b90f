"""Queries over the corpus tables, each applying one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import alignment, bpe, chat, decontaminate, fingerprint, minhash, ngram_lm, oracles, prefix_trie, substring, token_count, token_store, toxicity, warc
from orbweave.llm.common import table


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document: numbers and digests."""
    return bpe.encode_digest(table(spark, sf_dir, "documents"), path=tokenizer_path("word_bpe_49k.json"))


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by a model of six sevenths of them."""
    return ngram_lm.held_out_scores(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates: three words, 85 percent."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by a model of four fifths of the labels."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words that stand earlier too."""
    return substring.duplicate_digest(table(spark, sf_dir, "documents"), min_words=20)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats every conversation, and one full of marks, and reads them back."""
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.conversation_digest(chat.format_conversations(turns))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts the tokens of every document."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), model_path=tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints every document and its edited text."""
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page and reads the archives back."""
    _, records = warc.archive(table(spark, sf_dir, "pages"), min_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of every document to a store and reads each document back by its key."""
    docs = table(spark, sf_dir, "documents")
    own = token_store.write_store(docs, path=tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_store.read_documents(own, docs.select("doc_id")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt with starts in common."""
    return prefix_trie.prefix_trie(*prefix_trie.with_common_starts(prefix_trie.turn_digests(table(spark, sf_dir, "conversations"))))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligns the tokens of two tokenizers in every document."""
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), a_path=tokenizer_path("byte_bpe_50k.json"), b_path=tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_ngram_lm": op2_ngram_lm,
        "op3_minhash": op3_minhash,
        "op4_decontamination": op4_decontamination,
        "op5_toxicity": op5_toxicity,
        "op6_substring": op6_substring,
        "op7_chat": op7_chat,
        "op8_token_count": op8_token_count,
        "op9_fingerprint": op9_fingerprint,
        "op10_warc": op10_warc,
        "op11_token_store": op11_token_store,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; tests hold the others against brute force."""
    return {"op3_minhash": oracles.MINHASH, "op6_substring": oracles.SUBSTRING, "op7_chat": oracles.CHAT, "op10_warc": oracles.WARC, "op12_prefix_trie": oracles.PREFIX_TRIE}
