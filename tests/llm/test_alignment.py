import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from orbweave.llm import alignment, bpe, queries
from orbweave.llm.common import table
from test_tokens import strings

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EMPTY = (0, 0, 0, 0, 0, 0, "")


def brute_force(texts):
    """Rows of each text, from the libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(bpe.byte_letters())}
    out, links = [], []
    for text in texts:
        own = a.encode(" " + (text or ""), add_special_tokens=False)
        pieces = [(i, b.id_to_piece(i)) for i in b.encode(text or "")]
        left = [(i, bytes(byte_of[c] for c in t)) for i, t in zip(own.ids, own.tokens, strict=True)]
        right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
            out.append(None), links.append(Counter())
            continue
        groups, i, j, at, bt, xs, ys = [], 0, 0, 0, 0, [], []
        while i < len(left) or j < len(right):
            if at <= bt and i < len(left):
                xs.append(left[i][0]), (at := at + len(left[i][1])), (i := i + 1)
            else:
                ys.append(right[j][0]), (bt := bt + len(right[j][1])), (j := j + 1)
            if at == bt:
                groups.append((xs, ys))
                xs, ys = [], []
        out.append((len(left), len(right), groups))
        links.append(Counter((x, y) for xs, ys in groups for x in xs for y in ys))
    count = Counter(p for own in links for p in own)
    highest = {}
    for (x, _), n in count.items():
        highest[x] = max(n, highest.get(x, 0))
    rows = []
    for found, own in zip(out, links, strict=True):
        if found is None:
            rows.append(EMPTY)
            continue
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in found[2])
        best = sum(n for p, n in own.items() if count[p] == highest[p[0]])
        rows.append((found[0], found[1], len(found[2]), sum(own.values()), best, sum(n * count[p] for p, n in own.items()), hashlib.sha256(shown.encode()).hexdigest()))
    return rows


def odd_texts(n):
    rng = random.Random(3)
    spaces = [" ", " ", "  ", "\n", " \n", "\t ", "\xa0", "\xa0 ", "　 ", " ", "\x85 ", "  ", "\r\n", "\x1c ", " ", "\x0b"]
    words = ["the", "naïve", "don't", "日本語", "😀", "a▁b", "x" * 40, "\\n", "<|endoftext|>", "<s>", "12345", "qzj", "é", "\x00", "...", "'S"]
    return strings(300) + ["".join(rng.choice(spaces) * (rng.random() < 0.7) + rng.choice(words) for _ in range(rng.randint(1, 12))) + rng.choice(["", " ", "\n"]) for _ in range(n)]


def test_rows_equal_brute_force(spark):
    """Odd texts, in runs of few records and frames of few pairs; rows that repeat an id."""
    texts = odd_texts(1200)
    docs = spark.createDataFrame([(i if i % 50 else None, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, run int")
    found = alignment.align_tokenizers(docs.repartition(7), a_path=A, b_path=B, run_records=300).collect()
    expected = brute_force(texts)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, found), key=key) == sorted(((i if i % 50 else None, *r) for i, r in enumerate(expected)), key=key)
    assert sum(r != EMPTY for r in expected) > 1000 and EMPTY in expected


def test_query_equals_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    expected = {r.doc_id: x for r, x in zip(docs, brute_force([r.text for r in docs]), strict=True)}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op13_alignment(spark, sf_dir).collect()} == expected


@pytest.mark.parametrize("held", [1, 50, 1 << 20])
def test_merge_of_many_runs(monkeypatch, held):
    """Counts, and which are the highest of their A id, come back to the frames that they belong to."""
    monkeypatch.setattr(alignment, "HELD", held)
    rng = np.random.default_rng(1)
    runs, every = [], Counter()
    for _ in range(30):
        pairs = np.unique(rng.integers(0, 12, 60) << alignment._B_BITS | rng.integers(0, 40, 60))
        docs = rng.integers(1, 5, len(pairs))
        every.update(dict(zip(pairs.tolist(), docs.tolist(), strict=True)))
        cuts = list(range(0, len(pairs), 7))
        runs.append((pairs, ([int(pairs[k]) for k in cuts], [alignment.pack(np.diff(pairs[k : k + 7], prepend=0), docs[k : k + 7].astype(np.uint32)) for k in cuts])))
    runs.append((np.zeros(0, np.int64), ([], [])))
    top = {}
    for p, n in every.items():
        top[p >> alignment._B_BITS] = max(n, top.get(p >> alignment._B_BITS, 0))
    seen = 0
    for run, frame, found in alignment.merge_runs([r for _, r in runs]):
        own = runs[run][0][frame * 7 : frame * 7 + 7].tolist()
        assert alignment.unpack(found, "i8")[0].tolist() == [every[p] if every[p] == top[p >> alignment._B_BITS] else -every[p] for p in own]
        seen += len(own)
    assert seen == sum(len(p) for p, _ in runs)


def test_empty_table_and_units(spark, no_docs):
    assert alignment.align_tokenizers(no_docs, a_path=A, b_path=B).count() == 0
    data, starts, ends, owner = alignment.cut_units(pa.array(["a b", None, "", " ", "c ", "d\xa0 e　 f\n g"]))
    assert [(o, data[i:j].tobytes().decode()) for i, j, o in zip(starts, ends, owner, strict=True)] == [(0, "a"), (0, "b"), (3, " "), (4, "c"), (4, ""), (5, "d\xa0 e　 f\n g")]
