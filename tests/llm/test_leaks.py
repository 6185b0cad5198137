"""Leaks of items of any length and of any words, against alignment of all pairs."""

import random

import pytest

from stratograph.llm import decontamination


def found(spark, docs, items, settings=decontamination.Settings()):
    rows = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), settings).collect()
    return {(r["doc_id"], r["item_id"]): r for r in rows}


COMMON = ["the", "of", "and", "to", "in", "is", "that", "it"]


def corpus(r, n, rare=4000, words=120):
    """Texts of common words and rare ones, half and half."""
    return [[r.choice(COMMON) if r.random() < 0.5 else f"w{r.randrange(rare)}" for _ in range(words)] for _ in range(n)]


def test_a_short_item_between_rare_words(spark):
    r = random.Random(1)
    item = "what is the capital of france"
    docs = [[f"rare{r.randrange(10**6)}" for _ in range(80)] for _ in range(60)]
    texts = [(i, " ".join(d[:30] + (item.split() if i < 40 else []) + d[30:])) for i, d in enumerate(docs)]
    assert set(found(spark, texts, [(7, item)])) == {(i, 7) for i in range(40)}


def test_an_item_of_frequent_words(spark):
    r = random.Random(2)
    item = "it is that the of and to in the is of it"
    docs = corpus(r, 160)
    texts = [(i, " ".join(d[:50] + (item.split() if i < 100 else []) + d[50:])) for i, d in enumerate(docs)]
    assert set(found(spark, texts, [(3, item)])) == {(i, 3) for i in range(100)}


@pytest.mark.parametrize(("low", "high"), [(1, 2), (3, 8), (9, 15), (16, 40)])
@pytest.mark.parametrize("share", [0.0, 0.5, 0.9])
def test_recall_by_length_and_frequency(spark, low, high, share):
    """share: of an item's words that are common.  Copies are word for word, or with a word in ten changed."""
    r = random.Random(low * 10 + int(share * 10))
    items = [(k, [r.choice(COMMON) if r.random() < share else f"w{r.randrange(4000)}" for _ in range(r.randint(low, high))]) for k in range(30)]
    if low < 3:
        items = [(k, [f"only{k}"] * 1 + [f"w{k}"] * (len(x) - 1)) for k, x in items]  # one or two common words stand everywhere
    docs, planted = corpus(r, 90), set()
    for i, d in enumerate(docs[:60]):
        k, x = items[i % 30]
        copy = [f"x{r.random()}" if i >= 30 and len(x) >= 8 and r.random() < 0.1 else w for w in x]
        d[40:40] = copy
        a = decontamination._Item(list(range(len(x))))
        if a.in_order([j for j, (w, v) in enumerate(zip(x, copy)) if w == v]) >= 0.8 * len(x):
            planted.add((i, k))
    got = set(found(spark, [(i, " ".join(d)) for i, d in enumerate(docs)], [(k, " ".join(x)) for k, x in items]))
    assert len(got & planted) >= 0.9 * len(planted)
    exact = {(i, i % 30) for i in range(30)}
    assert exact <= got
    held = {(i, k) for i, d in enumerate(docs) for k, x in items if any(d[j : j + len(x)] == x for j in range(len(d)))}
    assert held <= got  # whatever stands word for word, planted or not


def test_clean_texts_stay(spark):
    r = random.Random(5)
    items = [(k, " ".join([r.choice(COMMON) if r.random() < 0.6 else f"i{r.randrange(3000)}" for _ in range(r.randint(6, 30))])) for k in range(40)]
    docs = spark.createDataFrame([(i, " ".join(d), 1) for i, d in enumerate(corpus(r, 300))], "doc_id long, text string, label int")
    assert decontamination.drop_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).count() >= 299


def test_several_passes_and_ties(spark):
    items = [(k, f"alpha{k} beta gamma delta{k} epsilon zeta eta theta{k}") for k in range(12)] + [(99, "alpha3 beta gamma delta3 epsilon zeta eta theta3")]
    docs = [(i, f"before {items[i % 12][1]} behind") for i in range(24)] + [(50, "clean words alone"), (51, None), (52, "")]
    settings = decontamination.Settings(items=4)
    got = found(spark, docs, items, settings)
    assert set(got) == {(i, i % 12) for i in range(24)} | {(3, 99), (15, 99)} and {r["common"] for r in got.values()} == {1.0}
    rows = spark.createDataFrame([(None if i == 5 else i, t) for i, t in docs], "doc_id long, text string")
    kept = decontamination.drop_leaks(rows, spark.createDataFrame(items, "item_id long, text string"), settings)
    assert sorted(r["doc_id"] for r in kept.collect()) == [50, 51, 52]
    assert decontamination.drop_leaks(rows, spark.createDataFrame([], "item_id long, text string")).count() == 27


def test_rare_words_lead_to_all_that_alignment_finds(spark):
    """Where words are looked for by the rarest ones first, nothing is lost that a search of everything finds."""
    import numpy as np
    import pyarrow as pa

    from stratograph.llm.ngram_join import pieces

    r = random.Random(6)
    s = decontamination.Settings()
    items = [[r.choice(COMMON) if r.random() < 0.5 else f"w{r.randrange(800)}" for _ in range(r.randint(1, 60))] for _ in range(30)] + [[f"long{k}" for k in range(200)]]
    docs = corpus(r, 60, rare=800, words=300)
    for i, d in enumerate(docs):
        x = items[i % 31]
        d[100:100] = [w for w in x if r.random() < 0.85 for w in ([w] if r.random() < 0.9 else [w, "more"])]  # words lost, words put in
    texts = pa.array([" ".join(d).encode() for d in docs], pa.binary())

    class Items:
        def orderBy(self, *_):
            return self

        def collect(self):
            return [{"item_id": k, "text": " ".join(x)} for k, x in enumerate(items)]

    blocks = [b for _, b in pieces(texts)]
    frequency = np.zeros(s.features, np.int64)
    for b in blocks:
        t = decontamination._Terms(b, s)
        frequency += np.bincount(np.unique(t.words.text * s.features + t.features) % s.features, minlength=s.features)
    weight = np.log((len(docs) + 1) / (frequency + 1)).clip(0) + s.least_weight
    m = decontamination._model(Items(), weight, frequency, s)
    gated = [decontamination._matches(decontamination._Terms(b, s), weight, m, s) for b in blocks]
    m["rare"].everywhere = True
    assert gated == [decontamination._matches(decontamination._Terms(b, s), weight, m, s) for b in blocks] and sum(map(len, gated)) > 20


def test_the_latent_space_is_that_of_all_passages(spark):
    """The distributed randomised SVD against a plain one of all passages of the corpus."""
    import numpy as np
    import pyarrow as pa

    from stratograph.llm.ngram_join import pieces

    r = random.Random(8)
    s = decontamination.Settings(features=1 << 10, latent=6, sketch=24)
    topics = [[f"t{k}w{j}" for j in range(12)] for k in range(6)]
    texts = [" ".join(r.choice(topics[i % 6]) if r.random() < 0.9 else f"w{r.randrange(300)}" for _ in range(40 + 30 * (i % 6))) for i in range(240)]
    weight = np.linspace(0.5, 1.5, s.features)
    frame = spark.createDataFrame([(t.encode(),) for t in texts] + [(None,), (b"",)], "text binary").repartition(5)
    axes = decontamination._latent_axes(frame, weight, s)
    rows = []
    for _, b in pieces(pa.array([t.encode() for t in texts], pa.binary())):
        t = decontamination._Terms(b, s)
        for a, z in zip(t.words.ends[:-1], t.words.ends[1:]):
            for i in range(a, z, s.stride):
                f = t.features[i : min(i + s.window, z)]
                rows.append(np.bincount(f, minlength=s.features) * weight / np.sqrt((weight[f] ** 2).sum()))
    a = np.array(rows)
    true = np.linalg.svd(a, full_matrices=False)[2][: s.latent].T
    assert axes.shape == true.shape and np.allclose(axes.T @ axes, np.eye(s.latent), atol=1e-6)
    assert np.linalg.norm(a @ axes) >= 0.99 * np.linalg.norm(a @ true)
    assert decontamination._latent_axes(frame.limit(0), weight, s).shape[1] == 0


def test_the_latent_space_alone_leads_to_leaks(spark):
    """Recall by the corpus's latent space, without spaces of items' own and without runs; what it finds, all searches find."""
    import numpy as np
    import pyarrow as pa

    from stratograph.llm.ngram_join import pieces

    r = random.Random(9)
    s = decontamination.Settings()
    items = [[r.choice(COMMON) if r.random() < 0.5 else f"w{r.randrange(800)}" for _ in range(r.randint(16, 60))] for _ in range(30)] + [[f"long{k}" for k in range(400)]]
    docs = corpus(r, 93, rare=800, words=200)
    for i, d in enumerate(docs):
        d[90:90] = [w for w in items[i % 31] if r.random() < 0.9]
    texts = [" ".join(d) for d in docs]
    frame = spark.createDataFrame([(t.encode(),) for t in texts], "text binary").repartition(3)
    frequency, n = decontamination._document_frequency(frame, s)
    weight = np.log((n + 1) / (frequency + 1)).clip(0) + s.least_weight
    table = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    m = decontamination._model(table, weight, frequency, s, decontamination._latent_axes(frame, weight, s))
    assert [x["latent"] for x in m["spaces"]] == [True] + [False] * (len(m["spaces"]) - 1)
    search = lambda m: {(first + d, i) for first, b in pieces(pa.array([t.encode() for t in texts], pa.binary())) for d, i in decontamination._matches(decontamination._Terms(b, s), weight, m, s)}
    alone, planted = search({**m, "spaces": m["spaces"][:1], "runs": []}), {(i, i % 31) for i in range(93)}
    assert len(alone & planted) >= 0.9 * len(planted) and {(i, 30) for i in (30, 61, 92)} <= alone
    assert alone <= search(m)
