import collections
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from orbweave.llm import decontaminate, ngram_lm, toxicity
from orbweave.llm.common import table


def kneser_ney(training, scored, order=2):
    """Interpolated modified Kneser-Ney with dictionaries."""
    tokens = lambda t: [*(t or "").encode().lower().split(), "</s>"]

    def grams(own, k):
        own = ["<s>"] * (order - 1) + own
        return [tuple(own[i - k + 1 : i + 1]) for i in range(order - 1, len(own))]

    uni, tables = collections.Counter(), {order: collections.Counter()}
    for t in training:
        uni.update(tokens(t))
        tables[order].update(grams(tokens(t), order))
    for k in range(order - 1, 0, -1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])
    cut = {k: ngram_lm.Discounts.estimate(*(sum(c == n for c in t.values()) for n in (1, 2, 3, 4))).values for k, t in tables.items()}
    follow = collections.defaultdict(list)
    for k in range(2, order + 1):
        for g, c in tables[k].items():
            follow[g[:-1]].append(c)
    less = lambda k, c: cut[k][min(c, 3) - 1] if c else 0.0
    v, n, pairs = len(uni), sum(uni.values()), len(tables[2])
    mass = sum(cut[1][min(tables[1][w,] or 3, 3) - 1] for w in uni) / pairs
    totals = {h: (sum(cs), sum(less(len(h) + 1, c) for c in cs)) for h, cs in follow.items()}
    out = []
    for t in scored:
        own, base, score = tokens(t), 0.0, 0.0
        for w, full in zip(own, grams(own, order), strict=True):
            p = (tables[1][w,] - less(1, tables[1][w,])) / pairs + mass / (v + 1)
            for k in range(2, order + 1):
                g = full[-k:]
                if g[:-1] in totals:
                    total, left = totals[g[:-1]]
                    p = (tables[k][g] - less(k, tables[k][g]) + left * p) / total
            score += math.log10(p)
            base += math.log10((uni[w] + 1) / (n + v + 1))
        out.append((len(own), sum(w in uni for w in own), base, score))
    return out, n


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_equals_dictionaries(spark, sf_dir, order):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in ngram_lm.held_out_scores(table(spark, sf_dir, "documents"), order=order).collect()}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    expected, n = kneser_ney([r.text for r in rows if not held[r.doc_id]], [r.text for r in rows], order)
    for r, (tokens, known, base, score) in zip(rows, expected, strict=True):
        f = found[r.doc_id]
        assert (f.held_out, f.n_tokens, f.n_known, f.train_tokens) == (held[r.doc_id], tokens, known, n)
        assert f.base_score == pytest.approx(base, rel=1e-9) and f.score == pytest.approx(score, rel=1e-6)
    out = [f for f in found.values() if f.held_out]
    assert sum(f.score for f in out) > sum(f.base_score for f in out)


def test_language_model_on_odd_and_empty_tables(odd_docs, no_docs):
    rows = ngram_lm.held_out_scores(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert ngram_lm.held_out_scores(no_docs).count() == 0
    three = ngram_lm.held_out_scores(odd_docs, order=3).collect()
    assert len(three) == len(rows) and all(math.isfinite(r.score) for r in three)


def test_language_model_in_many_buckets(spark, sf_dir):
    """Buckets by the size of the texts, more of them than shuffle partitions; the session's settings come back."""
    docs = table(spark, sf_dir, "documents")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    few, many = ngram_lm.fit(docs), ngram_lm.fit(docs, bucket_bytes=2000)
    assert many.bits > few.bits and spark.conf.get(name) == before
    texts = pa.array([r.text for r in docs.select("text").limit(50).collect()])
    for a, b in zip(few.score(texts), many.score(texts), strict=True):
        assert a == pytest.approx(b, rel=1e-12)


def test_probabilities_sum_to_one(spark):
    """Over all known words, the end and one unknown word, after words, an unknown one and the start."""
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices("abcdef", k=9))) for i in range(40)], "doc_id bigint, text string")
    for model, before in itertools.product([ngram_lm.fit(docs, order=k) for k in (2, 3)], ("a ", "f ", "a b ", "b b b ", "zzz ", "")):
        offs, _, _, logs = model.token_scores(pa.array([before + w for w in [*"abcdef", "zzz", ""]]))
        assert sum(10 ** logs[offs[:-1] + len(before.split())]) == pytest.approx(1, abs=1e-9)


def bags(n, seed):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choices(plain, k=rng.randint(3, 12)) for _ in range(rng.randint(1, 8))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            text[rng.randrange(len(text))].insert(1, rng.choice(["badword", "nastyish", "nastyest"]))
        rows.append((i, ". ".join(" ".join(s) for s in text) + ".", toxic))
    return rows


def test_toxicity_learns_sentences_from_document_labels(spark):
    rows = bags(800, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(y, found[i]) for i, _, y in rows if found[i].held_out]
    assert all(f.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, f in found.items())
    assert sum(y == f.predicted for y, f in held) / len(held) > 0.95
    model = toxicity.train(docs, labels)
    located = toxicity.offending_sentences(docs, model).collect()
    assert located and sum("badword" in r.words or "nasty" in r.words for r in located) / len(located) > 0.9
    assert toxicity.clean_documents(docs, model).count() == sum(r.score < 0.5 for r in toxicity.score_documents(docs, model).collect())


def test_toxicity_scores_and_weights_equal_brute_force(spark):
    """Scores by loops over sentences, and weights at which the likelihood cannot grow."""
    rows = bags(300, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))
    weight = dict(zip(model.ids.tolist(), model.weights.tolist(), strict=True))
    found = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    for i, text, _ in rows[:100]:
        clean = 1.0
        for sentence in text.split("."):
            own = toxicity.sentences(pa.array([sentence])).features.ravel().tolist()
            if own:
                clean *= 1 - 1 / (1 + math.exp(-model.bias - sum(weight.get(f, 0.0) for f in own)))
        assert found[i] == pytest.approx(1 - clean, abs=1e-5)
    rng = np.random.default_rng(1)
    toxic, plain = rng.integers(0, 2, 60), rng.integers(0, 3, 60)
    doc = np.sort(rng.integers(0, 60, 150))
    plain[np.bincount(doc, minlength=60) == 0] += 1
    sentence, feature = np.repeat(np.arange(150), 2), rng.integers(0, 8, 300)
    w, bias = toxicity.fit_noisy_or(toxic, plain, doc, sentence, feature, 8, rounds=3000, l2=0.5, weights=(1.0, 2.0))

    def loss(w, bias):
        total = 0.25 * (w**2).sum()
        for d in range(60):
            z = [bias] * plain[d] + [bias + sum(w[feature[sentence == s]]) for s in np.flatnonzero(doc == d)]
            clean = math.prod(1 - 1 / (1 + math.exp(-x)) for x in z)
            total -= 2.0 * math.log(1 - clean) if toxic[d] else math.log(clean)
        return total

    best = loss(w, bias)
    for k in range(9):
        for step in (-0.05, 0.05):
            assert loss(w + step * (np.arange(8) == k), bias + step * (k == 8)) > best - 1e-4


def test_toxicity_of_one_class_and_of_repeated_labels(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} text.") for i in range(60)], "doc_id bigint, text string")
    one = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id bigint, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, one).collect()} == {0}
    both = one.union(spark.createDataFrame([(i, 0) for i in range(60)], "doc_id bigint, toxic int"))  # the largest label counts
    assert {r.predicted for r in toxicity.toxicity(docs, both).collect()} == {0}


def test_toxicity_decides_alike_where_the_sample_is_bounded(spark):
    """A word of which three documents in ten are toxic is no reason to call one toxic, whether
    the sample has the classes' shares or as many documents of each."""
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        words, kind = rng.choices([f"w{k}" for k in range(300)], k=rng.randint(5, 12)), i % 10
        toxic = int(kind == 0 or kind == 1 and rng.random() < 0.3)
        if kind < 2:
            words.insert(2, ("badword", "doubtful")[kind])
        rows.append((i, " ".join(words) + ".", toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    probe = spark.createDataFrame([(0, "doubtful."), (1, "badword."), (2, "w1 w2.")], "doc_id bigint, text string")
    for per_class in (6000, 300):
        score = {r.doc_id: r.score for r in toxicity.score_documents(probe, toxicity.train(docs, labels, per_class=per_class)).collect()}
        assert score[0] == pytest.approx(0.3, abs=0.15) and score[1] > 0.5 and score[2] < 0.1


def test_toxicity_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    rows = toxicity.toxicity(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score < 0.5 and r.predicted == 0 for r in rows)
    assert toxicity.toxicity(no_docs, labels).count() == 0


def test_decontamination_finds_copies_and_paraphrases(spark):
    rng = random.Random(2)
    vocab = [f"t{i}" for i in range(4000)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(15, 60)))) for k in range(30)]
    rows, expected = [], set()
    for i in range(300):
        words = rng.choices(vocab, k=rng.randint(40, 400))
        if i % 10 == 0:
            k = rng.randrange(30)
            own = items[k][1].split()
            own = [w.upper() for w in own] if i % 20 else [w for w in own if rng.random() > 0.15]
            at = rng.randrange(len(words))
            words[at:at] = own
            expected.add((i, k))
        elif i % 10 == 5:
            words[5:5] = items[i % 30][1].split()[:5]  # a short quotation is no leak
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert found == expected


@pytest.mark.parametrize("copies", [True, False])
def test_decontamination_finds_items_that_many_documents_hold(spark, copies):
    """An item in a third of the documents, copies or not, and items of words that all documents
    hold, between words of other items."""
    rng = random.Random(6)
    vocab, common = [f"t{i}" for i in range(4000)], [f"c{i}" for i in range(40)]
    items = [(k, " ".join(rng.choices(vocab, k=30))) for k in range(20)] + [(20 + k, " ".join(rng.sample(common, n))) for k, n in enumerate((8, 12, 17, 25, 32, 40))]
    rare = sorted({w for _, t in items[:20] for w in t.split()})
    one = rng.choices(vocab, k=50) + items[0][1].split() + rng.choices(vocab, k=50)
    rows, expected = [], set()
    for i in range(300):
        words = one if copies else rng.choices(vocab, k=60) + items[0][1].split() + rng.choices(vocab, k=rng.randint(0, 60))
        if i % 3:
            words = [w for c in rng.sample(common, 40) for w in (c, *rng.choices(vocab, k=3))]
            if i % 30 == 1:
                words += rng.choices(rare, k=rng.randint(40, 60)) + items[20 + i // 30 % 6][1].split() + rng.choices(rare, k=40)
                expected.add((i, 20 + i // 30 % 6))
        else:
            expected.add((i, 0))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert found == expected


def exhaustive(docs, items, lcs=0.6, answer=0.5):
    """Every passage of every document against every item, on the texts."""
    found = set()
    words = decontaminate.terms_of(pa.array([t for _, t in docs], pa.string()))
    asked = decontaminate.terms_of(pa.array([t for _, t in items], pa.string()))
    for d, (doc, _) in enumerate(docs):
        own = words.hashes[words.offs[d] : words.offs[d + 1]]
        for k, (item, _) in enumerate(items):
            q = asked.hashes[asked.offs[k] : asked.offs[k + 1]]
            said = q[-max(3, len(q) // 4) :]
            for at in range(0, max(1, len(own) - 16), 16):
                near = own[max(0, at - len(q)) : at + 32 + len(q)]
                if np.isin(q, near).mean() >= lcs and np.isin(said, near).mean() >= answer and decontaminate.longest_common_subsequence(q, near) / len(q) >= lcs:
                    found.add((doc, item))
                    break
    return found


def test_decontamination_equals_an_exhaustive_search(spark, sf_dir):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).collect()}
    assert found == exhaustive(docs, items)


def planted(kind, own, other, rng):
    """An item as a document may hold it; ``other`` gives each word's synonym."""
    if kind == "dropped":
        return [w for w in own if rng.random() > 0.15]
    if kind == "synonyms":
        return [other[w] if rng.random() < 0.25 else w for w in own]
    if kind == "reordered":  # two neighbours in six change places
        return [w for k in range(0, len(own), 6) for w in (own[k : k + 6] if len(own) < k + 6 else [own[k + 1], own[k], *own[k + 2 : k + 6]])]
    return list(own)


def test_recall_of_plants_of_each_kind_by_both_searches_and_by_the_latent_one_alone(spark, monkeypatch):
    rng = random.Random(12)
    vocab = [f"t{i}" for i in range(1500)]
    other = {w: f"s{w}" for w in vocab}
    either = lambda n: [w if rng.random() < 0.6 else other[w] for w in rng.choices(vocab, k=n)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(20, 45)))) for k in range(120)]
    kinds, rows, expected = ("literal", "dropped", "reordered", "synonyms"), [], {}
    for i in range(240):
        words = either(rng.randint(40, 200))
        if i % 2:
            kind, k = kinds[i // 2 % 4], i // 2 % 120
            at = rng.randrange(len(words))
            words[at:at] = planted(kind, items[k][1].split(), other, rng)
            expected.setdefault(kind, set()).add((i, k))
        rows.append((i, " ".join(words)))
    docs, asked = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    every = exhaustive(rows, items)
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, asked).collect()}
    assert found <= every and len(found) >= 0.99 * len(every)
    for kind, own in expected.items():
        assert len(found & own) >= 0.9 * len(own & every) and len(own & every) >= 0.8 * len(own), kind  # the others lost their answers
    search = decontaminate.Search(decontaminate._items([{"id": i, "text": t, "answer": ""} for i, t in items], 8), np.ones(len({w for _, t in items for w in t.split()}), np.float32))
    decontaminate.fit_latent(docs, search)
    assert search.basis.shape[1] == 60 < len(items)  # half the items
    hits = {(i, k) for i, t in rows for _, k, _ in _latent_only(search, t)}
    for kind, own in expected.items():
        assert len(hits & own) >= 0.9 * len(own & every), kind


@pytest.mark.parametrize("gap", [2, 3])
def test_items_spread_over_other_words(spark, monkeypatch, gap):
    """Two or three words between an item's words, benchmark words among them; one block of items and several."""
    rng = random.Random(gap)
    vocab = [f"t{i}" for i in range(1500)]
    both = vocab + [f"s{w}" for w in vocab]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(20, 45)))) for k in range(100)]
    rows = []
    for k, text in items:
        words = rng.choices(both, k=rng.randint(40, 200))
        at = rng.randrange(len(words))
        words[at:at] = [x for w in text.split() for x in (w, *rng.choices(both, k=gap))]
        rows.append((k, " ".join(words)))
    docs, asked = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    every = exhaustive(rows, items)
    found = {tuple(r)[:2] for r in decontaminate.contaminated(docs, asked).collect()}
    assert found <= every and len(found) >= 0.95 * len(every) and len(every) > 50
    search = decontaminate.Search(decontaminate._items([{"id": i, "text": t, "answer": ""} for i, t in items], 8), np.ones(len({w for _, t in items for w in t.split()}), np.float32))
    decontaminate.fit_latent(docs, search)
    assert len({(i, k) for i, t in rows for _, k, _ in _latent_only(search, t)} & every) >= 0.9 * len(every)
    monkeypatch.setattr(decontaminate, "SEARCH_BYTES", 300_000)
    calls, real = [], decontaminate.fit_latent
    monkeypatch.setattr(decontaminate, "fit_latent", lambda *args: calls.append(1) or real(*args))
    in_blocks = {tuple(r)[:2] for r in decontaminate.contaminated(docs, asked).collect()}
    assert len(calls) > 3 and in_blocks <= every and len(in_blocks) >= 0.95 * len(every)


def _latent_only(search, text):
    words = decontaminate.terms_of(pa.array([text]))
    search.literal = lambda *_: (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return search.confirmed(words)


def test_latent_basis_equals_the_singular_vectors(spark):
    """The span holds as much of passages and items as that of numpy's decomposition."""
    rng = random.Random(3)
    topics = [[f"t{k}x{i}" for i in range(30)] for k in range(6)]
    items = [(k, " ".join(rng.choices(topics[k % 6], k=20))) for k in range(24)]
    rows = [(i, " ".join(rng.choices(topics[i % 6], k=rng.randint(10, 120)))) for i in range(80)]
    search = decontaminate.Search(decontaminate._items([{"id": i, "text": t, "answer": ""} for i, t in items], 8), np.linspace(0.5, 2, len({w for _, t in items for w in t.split()})).astype(np.float32))
    decontaminate.fit_latent(spark.createDataFrame(rows, "doc_id bigint, text string"), search, latent=6)
    h, at, term = search.weighted(decontaminate.terms_of(pa.array([t for _, t in rows])))
    dense = np.diag(search.idf)
    passages, own = search.project(h, at, term, dense.astype(np.float32)), search.item_sums(np.eye(len(dense), dtype=np.float32))
    whole = np.concatenate([passages, own * np.sqrt((passages.sum(1) ** 2).sum() / (own**2).sum())])
    best = (np.linalg.svd(whole, compute_uv=False)[:6] ** 2).sum()
    basis = search.basis / search.idf[:, None]
    assert np.allclose(basis.T @ basis, np.eye(6), atol=1e-4)
    assert ((whole @ basis) ** 2).sum() > 0.98 * best


def test_short_items_have_to_stand_there_whole(spark):
    docs = spark.createDataFrame([(1, "a short, QUESTION here"), (2, "short here question"), (3, "question"), (4, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "short question"), (2, "Question!"), (3, "..."), (4, "short")], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id, r.lcs) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(1, 1, 1.0), (1, 2, 1.0), (2, 2, 1.0), (3, 2, 1.0), (1, 4, 1.0), (2, 4, 1.0)}


def test_decontamination_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, None), (None, "a b c d e f g h i j k")], "item_id bigint, text string")
    assert decontaminate.contaminated(odd_docs, items).count() == 0
    assert decontaminate.contaminated(no_docs, items).count() == 0
    assert decontaminate.contaminated(odd_docs, items.limit(0)).count() == 0


def test_common_subsequence_equals_the_table():
    rng = random.Random(4)
    for _ in range(50):
        a, b = (np.array(rng.choices(range(6), k=rng.randint(1, 70))) for _ in range(2))
        grid = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                grid[i + 1, j + 1] = grid[i, j] + 1 if x == y else max(grid[i, j + 1], grid[i + 1, j])
        assert decontaminate.longest_common_subsequence(a, b) == grid[-1, -1]


def test_mix_is_a_permutation():
    from orbweave.llm.common import mix, unmix

    x = np.concatenate([np.arange(1000), np.random.default_rng(1).integers(0, 2**63, 1000)]).astype(np.uint64)
    assert (unmix(mix(x)) == x).all() and (mix(unmix(x)) == x).all()


def test_labels_without_a_document_do_not_count(spark):
    """They take no place in the sample, however many there are."""
    docs = spark.createDataFrame([(i, "you are an awful awful fool" if i % 2 else "the house is by the sea") for i in range(60)], "doc_id bigint, text string")
    own = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    strange = spark.range(1000, 6000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    models = [toxicity.train(docs, labels, per_class=20) for labels in (own, own.union(strange))]
    assert len(models[0].ids) and np.array_equal(models[0].ids, models[1].ids) and np.allclose(models[0].weights, models[1].weights)
