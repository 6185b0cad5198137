"""The pipeline's rows against a brute-force version of each stage after the other."""

import random
import zlib

import duckdb
import pandas as pd
import public_tokenizers
import tokenizers
from test_edges import naive_bayes
from test_joins import closure, shingles

import corpus_pipeline
from stratograph.llm import decontamination, language_id, oracles

ITEMS = [(0, " ".join(f"ka{chr(97 + i % 26)}bel{i}" for i in range(24))), (1, "who made the first boat of reeds"), (2, " ".join(f"zu{i}" for i in range(12)))]


def fixture():
    r = random.Random(21)
    words = {k: ["".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(150)] for k, letters in (("x", "abcdeé"), ("y", "ghijkü"), ("z", "mnopqñ"))}
    rows = []
    for i in range(90):
        lang = "xyz"[i % 3]
        rows.append([i, " ".join(r.choice(words[lang]) for _ in range(r.randint(30, 120))), lang, f"s{i % 4}" if i % 9 else None, 1])
    for i in range(10):  # near copies and copies
        text = rows[i][1].split()
        text[r.randrange(len(text))] = "other"
        rows.append([200 + i, " ".join(text) if i % 2 else rows[i][1], rows[i][2], "s1", 1])
    for i in range(12):  # benchmark items inside
        text = rows[40 + i][1].split()
        text[10:10] = ITEMS[i % 3][1].split()
        rows.append([300 + i, " ".join(text[len(text) // 3 * (i % 2) :] + [f"end{i}"] * 20), rows[40 + i][2], "s2", 1])
    return [tuple(x) for x in rows] + [(400, "123 45, 6!", "x", "s0", 1), (401, None, "y", "s0", 1), (402, "", "z", "s1", 1)]


def brute_force(rows):
    """Languages, all pairs, all windows, SQL for the mix, the tokenizers library."""
    learn = [(t, k) for i, t, k, *_ in rows if t is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    found = naive_bayes(learn, [x[1] for x in rows], language_id.Settings())
    rows = [x for x, (lang, score) in zip(rows, found) if lang != "und" and score >= 0.5]

    sets = {x[0]: shingles(x[1], 5) for x in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = closure(ids, links)
    rows = [x for x in rows if low[x[0]] == x[0]]

    def holds(text):
        w = text.split()
        return any(w[i : i + len(x.split())] == x.split() for _, x in ITEMS for i in range(len(w)))

    rows = [x for x in rows if not holds(x[1])]

    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    taken = {d: t // s for d, s, t in duckdb.sql(f"SELECT doc_id, size, taken FROM ({oracles.MIXING})").fetchall()}
    rows = [x for x in rows for _ in range(int(taken[x[0]]))]

    library, out, start = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    for x in sorted(rows):
        ids = library.encode(x[1], add_special_tokens=False).ids + [2]
        out.append((x[0], start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    want = brute_force(rows)
    assert sorted(map(tuple, got)) == sorted(want)
    ids = {w[0] for w in want}  # copies, items and unknown languages are gone, some documents come twice
    assert 60 < len(ids) < len(want) and not ids & {*range(200, 210, 2), *range(300, 312, 2), 400, 401, 402}


def test_decontamination_searches_the_latent_space_of_its_documents(spark, tmp_path, monkeypatch):
    """The stage's distributed SVD takes all rows it gets, and its space alone, without the other searches, leads to leaks."""
    r = random.Random(23)
    rows = [r for r in fixture() if r[1] and len(r[1].split()) > 6]
    words = sorted({w for x in rows for w in x[1].split()})
    items = [(i, " ".join(r.choice(words) for _ in range(30))) for i in range(12)]
    leaks = [[500 + i, " ".join([*rows[i][1].split()[:60], *(w for w in items[i % 12][1].split() if r.random() < 0.9)]), "x", "s1", 1] for i in range(36)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([*rows, *map(tuple, leaks)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    sketched, model, axes = [], decontamination._model, decontamination._latent_axes
    monkeypatch.setattr(decontamination, "_latent_axes", lambda texts, *x: sketched.append(texts.count()) or axes(texts, *x))

    def latent_alone(*x):
        m = model(*x)
        return {**m, "spaces": [space for space in m["spaces"] if space.get("latent")], "runs": []}

    monkeypatch.setattr(decontamination, "_model", latent_alone)
    kept = {x["doc_id"] for x in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).select("doc_id").collect()}
    planted = {x[0] for x in leaks}
    assert sketched == [len(rows) + len(leaks)]
    assert len(planted - kept) >= 0.9 * len(planted) and {x[0] for x in rows} <= kept
