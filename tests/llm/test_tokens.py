import hashlib
import random

import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orbweave.llm import bpe, token_count
from orbweave.llm.common import split_words, table

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "\r", "a", "B", "the", "▁", "é", "é", "日", "😀", "ing", "'s", "'RE", ".", "<|startoftext|>", "<|endoftext|>", "<|", "<s>", "\x1c", "　", "1", "Hello", "Σ", "İ", "!!", "\x85", "​", "ß", "ﬁ", "क", "्", "\x00"]


def strings(n):
    rng = random.Random(5)
    return ["", " ", "  ", "\n", " \n a", "a  ", None, *("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)), "a" * 5000, "ab!" * 3000, " " * 3000, "supercalifragilistic" * 6]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_words_are_split_at_six_bytes_only():
    words = split_words(pa.array(["a b\x0bc", "d", None, "\x1ce\xa0f "]))
    assert [words.word(i) for i in range(len(words.starts))] == [b"a", b"b", b"c", b"d", "\x1ce\xa0f".encode()]
    assert words.offs.tolist() == [0, 3, 4, 4, 5]


def test_piece_counts_equal_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = strings(1500)
    found = token_count.piece_counter(PIECES).count_texts(pa.array(texts))
    assert found.tolist() == [len(library.encode(t or "")) for t in texts]


def test_piece_counts_of_texts_of_over_four_million_symbols():
    """Against the same sentences apart: nothing merges across their ends."""
    counter = token_count.piece_counter(PIECES)
    rng = random.Random(7)
    lines = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) + "\r" for _ in range(1000)]
    text = "".join(lines) * 900
    assert len(text) > 5_000_000
    part = counter.count_texts(pa.array(["".join(lines) * k for k in (1, 2)])).tolist()
    assert counter.count_texts(pa.array([text])).tolist() == [part[0] + 899 * (part[1] - part[0])]


def test_word_ids_equal_the_library_and_decode():
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(WORDS), bpe.word_codec(WORDS)
    texts = strings(1500)
    expected = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    n, ids, decoded = codec.digest(pa.array(texts))
    assert n == [len(e.ids) for e in expected]
    assert ids == [sha(" ".join(map(str, e.ids))) for e in expected]
    assert decoded == [sha(library.decode(e.ids, skip_special_tokens=False)) for e in expected]
    array = codec.encode_array(pa.array(texts))
    assert array.to_pylist() == [e.ids for e in expected]
    assert codec.decode_array(array).to_pylist() == [library.decode(e.ids, skip_special_tokens=False) for e in expected]


@pytest.mark.parametrize("size", [1, 63, 64, 65, 200])
def test_long_words_take_the_heap_and_agree(size):
    codec = bpe.word_codec(WORDS)
    word = ("theinganderst" * 20)[:size].encode()
    raw = [*codec.inner[list(word[:-1])].tolist(), int(codec.final[word[-1]])]
    assert codec.table.merge_long(raw) == codec.encode_words([word])[0]


def test_columns_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    coded = bpe.decode_column(bpe.encode_column(odd_docs, path=WORDS), path=WORDS)
    assert coded.columns == [*odd_docs.columns, "token_ids", "decoded"]
    assert coded.count() == odd_docs.count()
    assert coded.filter("doc_id = 2").select(F.size("token_ids"), "decoded").first() == (0, "")
    assert bpe.encode_digest(no_docs, path=WORDS).count() == 0
    counted = token_count.count_tokens(odd_docs, model_path=PIECES)
    assert counted.count() == odd_docs.count()
    assert counted.filter("doc_id = 1").first()[1:] == (0, 0, False)
    assert counted.filter("doc_id = 7").first()["over_limit"]
    assert token_count.count_tokens(no_docs, model_path=PIECES).count() == 0


def test_whole_table_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    coded = bpe.encode_column(docs, path=WORDS).select("doc_id", F.size("token_ids").cast("bigint").alias("n"))
    assert coded.join(bpe.encode_digest(docs, path=WORDS), "doc_id").filter("n != n_tokens").count() == 0


def test_ids_of_every_code_point():
    """Each alone, between letters and between digits: classes and lower case are the library's."""
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(WORDS), bpe.word_codec(WORDS)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    near = [c for c in every if ord(c) < 0x34000 or 0xE0000 <= ord(c) < 0xE0200]
    for texts in (every, [f"a{c}b" for c in near], [f"1{c}1" for c in near]):
        expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert codec.encode_array(pa.array(texts)).to_pylist() == expected
        assert texts is every or codec.digest(pa.array(texts))[1] == [sha(" ".join(map(str, e))) for e in expected]


def test_ids_of_many_random_texts():
    from tokenizers import Tokenizer

    rng = random.Random(11)
    pools = [PARTS, [chr(c) for c in range(0x20, 0x250)], [chr(rng.randrange(0x34000)) for _ in range(4000)], ["́", "̣", "e", "o", "ᄀ", "ᅡ", "ᆨ", "क", "़", "ে", "া", "'", "s", "<|", " "]]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 25))).encode("utf-8", "ignore").decode() for pool in pools for _ in range(5000)]
    library, codec = Tokenizer.from_file(WORDS), bpe.word_codec(WORDS)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert codec.encode_array(pa.array(texts)).to_pylist() == expected
    assert codec.digest(pa.array(texts))[1] == [sha(" ".join(map(str, e))) for e in expected]
