"""Nulls, repeats, hot groups, long words and texts, clashing names and empty tables, for every operator."""

import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from stratograph.llm import bpe, chat_format, decontamination, embedding_dedup, exchange, language_id, mixing, ngram_join, sharding, substring_dedup, suffix_dedup, token_output

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n, a="a", b="b"):
    s = [0]
    while len(s) < n:
        s += [1 - x for x in s]
    return "".join(b if x else a for x in s)


LONG = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (256, 1024, 4096, 8192)]


@pytest.mark.parametrize("pair", LONG)
def test_long_words_are_told_apart(pair):
    a, b = pair
    block = exchange.Block.__new__(exchange.Block)
    import numpy as np

    block.ids, block.ends = np.arange(2), np.array([0, len(a), 2 * len(a)])
    block.data = np.frombuffer((a + b).encode(), np.uint8)
    for lanes in (1, 2):
        words = substring_dedup.Words(block, lanes=lanes)
        assert all(h.levels[0][0] != h.levels[0][1] for h in words.hashes)
    letters = exchange.Hashes(exchange.word_names(block.data, np.arange(len(block.data)), np.arange(1, len(block.data) + 1), 1)[0], 0)
    assert len(set(letters.of(block.ends[:-1], block.ends[1:]).tolist())) == 2
    assert len(set(exchange.byte_names(block.data, block.ends[:-1], len(a), 1)[0].tolist())) == 2


def test_encoder_tells_long_words_apart():
    encoder = bpe.Encoder.of(TOKENIZER)
    texts = [w for pair in LONG for w in pair] * 2
    values, offsets = encoder.encode(pa.array(texts, pa.string()), 2)
    got = [values[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == [x.ids + [2] for x in encoder.library.encode_batch(texts, add_special_tokens=False)]


def test_long_words_do_not_repeat_or_link(spark):
    a, b = LONG[1]
    texts = [(i, " ".join([w] * 1 + [f"{w}{k}" for k in range(19)])) for i, w in enumerate((a, b))]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["n_removed"] for r in substring_dedup.repeated_words(rows).collect()} == {0}
    got = ngram_join.link_documents(spark.createDataFrame([(0, a), (1, b), (2, a)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 1, 2: 0}


def test_item_that_every_document_holds_is_found(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank on monday"
    docs = spark.createDataFrame([(i, f"{x} {item} {x}") for i, x in enumerate(("one", "two"))], "doc_id long, text string")
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = decontamination.find_leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"], r["common"]) for r in got} == {(0, 5, 1.0), (1, 5, 1.0)}
    assert decontamination.drop_leaks(docs, items).count() == 0


def test_leaks_with_repeats_nulls_and_clashing_names(spark):
    item = " ".join(f"word{i}" for i in range(30))
    rows = [(1, "x " + item, 0, "a"), (1, "x " + item, 0, "a"), (1, "nothing here", 0, "b"), (None, item, 0, "c"), (2, None, 0, "d"), (3, "clean text", 0, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _leak int, `a.b` string")
    items = spark.createDataFrame([(7, item), (7, item), (8, item)], "item_id long, text string")
    found = decontamination.find_leaks(docs, items).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in found) == [(-1, 7), (-1, 8), (1, 7), (1, 7), (1, 8), (1, 8)]
    kept = decontamination.drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or -1, r["text"]) for r in kept.na.fill("", ["text"]).collect()) == [(1, "nothing here"), (2, ""), (3, "clean text")]  # by row, not by id


def test_very_long_item(spark):
    r = random.Random(1)
    item = " ".join(f"w{r.randrange(5000)}" for _ in range(20_000))
    docs = spark.createDataFrame([(0, "before " + item + " after"), (1, " ".join(item.split()[:5000]))], "doc_id long, text string")
    got = decontamination.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {0}


def test_mix_keeps_to_its_plan_where_rows_repeat(spark):
    rows = [(1, "a b c", "s", 0, 1.0)] * 6 + [(1, "d e", "s", 0, 1.0), (None, "f g h i", None, 0, 1.0), (None, "f g h i", None, 0, 1.0), (3, None, "s", 0, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_row int, `a.b` double")
    plan = mixing.mix_plan(docs).collect()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and len(plan) == len(rows)
    words = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert words == sum(r["taken"] for r in plan) and mixed.count() == sum(r["copies"] for r in plan)
    copies = [r["copies"] for r in plan if (r["size"], r["source"]) == (3, "s")]
    assert max(copies) - min(copies) <= 1


@pytest.mark.parametrize("names", ["doc_id long, text string, source string", "doc_id long, text string, source string, copies int, h string"])
def test_mix_of_nothing(spark, names):
    empty = spark.createDataFrame([], names)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_documents_with_clashing_names_and_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, 0, "x"), (1, b, 0, "x"), (2, b, 0, "y"), (3, a, 0, "z"), (4, "c d e", 0, "w"), (None, a, 0, "n"), (None, a, 0, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept int, `a.b` string")
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.link_documents(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (None, None)}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 1, 4]


def test_very_long_document_links(spark):
    words = [f"w{i}" for i in range(60_000)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:-1000])), (2, " ".join(words[:30_000]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (59_998, 0), 1: (58_998, 0), 2: (29_998, 2)}


def test_crowded_hub_and_random_equal_prefixes(spark):
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(200):
        words = list(base)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = f"e{r.randrange(4)}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(58)} for i, t in rows}
    up = list(range(200))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(200):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {i: find(i) for i in range(200)}


def test_repeated_vector_ids(spark):
    rows = [(1, [1.0, 0.0], 5), (1, [0.0, 1.0], 5), (2, [0.0, 1.0], 5), (3, [1.0, 0.01], 5), (4, [-1.0, 0.0], 5)]
    got = [tuple(r) for r in embedding_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, w int")).collect()]
    assert sorted(got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def test_languages_with_odd_rows(spark):
    rows = [(i, "ka ko ki ka" if i % 2 else "lu le lu lo", "x" if i % 2 else "y") for i in range(60)]
    rows += [(None, "ka ko", "x"), (7, "ka ko", "x"), (7, "ka ko", "x")]
    docs = spark.createDataFrame([(*r, "p", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, `a.b` double")
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got if r["doc_id"] is None} == {"x"}
    kept = language_id.keep_identified(docs.withColumnRenamed("lang_pred", "_lang_pred"))
    assert kept.columns == ["doc_id", "text", "lang", "_lang_pred", "a.b"] and kept.count() == len(rows)


def test_every_language_is_learned(spark):
    rows = [(i, f"q{chr(0x4E00 + i % 300)} " * 5, f"l{i % 300}") for i in range(1800)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id'] % 300}" for r in got) > 0.95 * len(rows)


def naive_bayes(learn, texts, settings):
    """Counts in dictionaries, one text at a time."""
    import math

    def grams(text):
        low, out, row = f" {(text or '').lower()} ", [], []
        for i, c in enumerate(low):
            if c.isalpha() or i == 0 or low[i - 1].isalpha():
                row.append(ord(c) if c.isalpha() else 32)
        for n in settings.orders:
            for i in range(len(row) - n + 1):
                key = 0
                for k in range(n):
                    key = ((key * 0x9E3779B97F4A7C15) % 2**64) ^ (row[i + k] + k + 1)
                mixed = ((key ^ (key >> 29)) * 0xBF58476D1CE4E5B9) % 2**64
                out.append((n, (mixed >> 40) % settings.features))
        return out, any(c.isalpha() for c in text or "")

    count, total, rows = {}, {}, {}
    for text, lang in learn:
        rows[lang] = rows.get(lang, 0) + 1
        for g in grams(text)[0]:
            count[lang, g] = count.get((lang, g), 0) + 1
            total[lang, g[0]] = total.get((lang, g[0]), 0) + 1
    out = []
    for text in texts:
        found, letters = grams(text)
        score = {k: math.log(v / sum(rows.values())) for k, v in rows.items()}
        for k in score:
            for g in found:
                score[k] += math.log((count.get((k, g), 0) + settings.smoothing) / (total.get((k, g[0]), 0) + settings.smoothing * settings.features))
        best = max(sorted(score), key=score.get)
        out.append((best, 1 / sum(math.exp(v - score[best]) for v in score.values())) if letters else ("und", 0.0))
    return out


def test_language_id_equals_brute_force(spark):
    r = random.Random(12)
    letters = {"x": "abcdeé", "y": "defghü", "z": "ghiñjk"}
    rows = [(i, " ".join("".join(r.choice(letters[k]) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 12))), k) for i, k in enumerate(["x", "y", "z", "x"] * 40)]
    rows += [(500, "12, 3!", "x"), (501, None, "y"), (502, "", "z"), (503, "Ab-cd\n ef", None)]
    got = {x["doc_id"]: x for x in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    learn = [(t, k) for i, t, k in rows if t is not None and k is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    want = naive_bayes(learn, [t for _, t, _ in rows], language_id.Settings())
    for (i, _, _), (lang, score) in zip(rows, want):
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=2e-4)


@pytest.mark.parametrize("rows", [[(7, "same text", 1)] * 4000, [(None, f"t{i}", 1) for i in range(2000)], [(i, "same text", 1) for i in range(3000)]])
def test_shards_of_repeated_rows_are_near_equal(spark, rows):
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, item int"), 8).collect()
    sums = {}
    for r in got:
        sums.setdefault(r["shard"], []).append(r)
    sizes = [sum(r["size"] for r in v) for v in sums.values()]
    assert len(got) == len(rows) and len(sums) == 8 and max(sizes) < 1.15 * min(sizes)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in sums.values())


def test_shards_of_few_long_texts_and_of_nothing(spark):
    rows = [(i, f"{i} " * 5000, 1) for i in range(64)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, `a.b` int"), 4).collect()
    sums = {}
    for r in got:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
    assert max(sums.values()) < 1.2 * min(sums.values())
    assert sharding.shard(spark.createDataFrame([], DOCS), 4).count() == 0


def test_tokens_with_null_ids_and_clashing_names(spark):
    rows = [(None, "a b", [1], 1), (None, None, [1], 1), (5, "c", [1], 1), (5, "c", [1], 1)]
    got = token_output.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, part int"), TOKENIZER).collect()
    assert sorted((r["doc_id"] is not None, r["n_tokens"]) for r in got) == [(False, 1), (False, 3), (True, 2), (True, 2)]
    assert sorted(r["start"] for r in got) in ([0, 1, 4, 6], [0, 3, 4, 6])


def test_chat_of_nothing_and_long_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat_format.format_conversations(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"text {i} " * 5) for i in range(400)]
    got = chat_format.format_conversations(spark.createDataFrame(rows, schema)).collect()
    assert got[0]["n_turns"] == 400 and got[0]["loss_chars"] == sum(len(t) for _, _, r, t in rows if r == "assistant")


def test_least_id_and_texts_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK", 500)
    low, r = -(1 << 63), random.Random(2)
    text = " ".join(f"w{r.randrange(10**6)}" for _ in range(400))
    rows = [(low, text), (0, "new " + text[1000:]), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = [(i, (t or "").encode()) for i, t in rows if i is not None]
    first = [(low - 1, text.encode())]  # null ids come first
    for got, want in (
        (suffix_dedup.digest(suffix_dedup.repeated_spans(docs)), suffix_dedup.brute_force(first + known, 100)),
        (substring_dedup.digest(substring_dedup.repeated_words(docs)), substring_dedup.brute_force(first + known, 20)),
    ):
        assert {tuple(x) for x in got.collect()} == {(None if w[0] == low - 1 else w[0], *w[1:]) for w in want}


def test_pipeline_of_nothing_and_of_repeats(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(0, "a benchmark item that nobody has ever seen before in any of these texts")], "item_id long, text string").write.parquet(str(tmp_path / "a" / "benchmark.parquet"))
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() == 0
    r = random.Random(3)
    rows = [(i // 2, " ".join(r.choice(["the", "of", "and", "lo"]) for _ in range(40)), "en", "s", 1) for i in range(80)]
    spark.createDataFrame([(0, "a benchmark item that nobody has ever seen before in any of these texts")], "item_id long, text string").write.parquet(str(tmp_path / "b" / "benchmark.parquet"))
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "b")).select("doc_id").distinct()
    assert 0 < out.count() <= 40
    assert out.filter(F.col("doc_id") >= 40).count() == 0
