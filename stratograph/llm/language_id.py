"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in numpy and sums them in Spark; the smoothed
log-probability matrix (features x languages, a size fixed by two parameters) is broadcast,
and texts are scored as sparse rows: the matrix is gathered at each n-gram and summed by text.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import by_arrow, col, fresh, unit

#: What texts without a letter, and null texts, get.
UNKNOWN = "und"
#: Characters scored at a time.
PIECE = 1 << 17


@dataclass(frozen=True)
class Settings:
    """orders: lengths of n-grams; features: hash buckets of each order; most_rows: training
    rows of each language at most, in expectation (a hash sample above that); smoothing: the
    count added to each bucket.  Every language that occurs is learned."""

    orders: tuple[int, ...] = (1, 2, 3)
    features: int = 1 << 15
    most_rows: int = 4000
    smoothing: float = 0.5


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # float32, (orders * features, languages)
    prior: np.ndarray
    settings: Settings = field(default_factory=Settings)


_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.frombuffer(bytes(chr(c).isalpha() for c in range(sys.maxunicode + 1)), np.bool_)
    return _letters


def _pieces(texts: list[str | None]):
    """Runs of rows of about PIECE characters; one longer text makes a run of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > PIECE:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def _grams(texts: list[str | None], settings: Settings):
    """(features, rows, has_letter): hashed n-grams of each text, words padded by one space."""
    low = [f" {(t or '').lower()} " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    letter = _letter_table()[codes]
    row = np.repeat(np.arange(len(low)), sizes)
    has = np.bincount(row, letter, len(low)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space stands for whatever lies between words
    keep[np.cumsum(sizes) - sizes] = True  # the one before each text's first word, wherever the text lies
    codes, row = np.where(letter, codes, np.uint32(32))[keep].astype(np.uint64), row[keep]
    mask = np.uint64(settings.features - 1)
    found, rows = [], []
    key = np.zeros(len(codes), np.uint64)
    for n in range(1, max(settings.orders) + 1):
        if len(codes) < n:
            break
        key = (key[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[n - 1 :] + np.uint64(n))
        if n in settings.orders:
            mixed = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            at = ((mixed >> np.uint64(40)) & mask).astype(np.int64) + settings.orders.index(n) * settings.features
            same = row[: len(at)] == row[n - 1 :]
            found.append(at[same])
            rows.append(row[: len(at)][same])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    return np.concatenate(found), np.concatenate(rows), has


def train(labelled: DataFrame, settings: Settings = Settings(), id_col="doc_id", text_col="text", lang_col="lang") -> Model:
    """Learn from rows with text and language.

    Of a language with more than ``most_rows`` rows a hash sample of about that many is read,
    so the model costs the same at every size; what comes back to the driver is bounded by
    features x languages, whatever the number of rows.  Rows with null text or language teach nothing; with no rows at
    all the model knows no language and calls every text ``und``.
    """
    rows = labelled.select(col(id_col).alias("i"), col(text_col).cast("string").alias("t"), col(lang_col).cast("string").alias("l"))
    rows = rows.filter("t is not null and l is not null")
    counts = rows.groupBy("l").agg(F.count("*").alias("n")).collect()  # one row a language
    languages = sorted(r["l"] for r in counts)
    width = len(settings.orders) * settings.features
    if not languages:
        return Model([], np.zeros((width, 0), np.float32), np.zeros(0), settings)
    seen = {r["l"]: r["n"] for r in counts}
    share = F.create_map(*[x for k, n in seen.items() for x in (F.lit(k), F.lit(min(1.0, settings.most_rows / n)))])
    rows = rows.filter(unit("language", F.col("i").cast("string")) < share[F.col("l")])
    number = {k: i for i, k in enumerate(languages)}

    def count(batches):
        total = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _pieces(texts):
                at, row, _ = _grams(texts[a:b], settings)
                which = np.array([number[x] for x in langs[a:b]])
                for k in set(which.tolist()):
                    total[k] = total.get(k, 0) + np.bincount(at[which[row] == k], minlength=width)
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["k", "at", "n"])

    found = by_arrow(rows.select("t", "l"), count, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((width, len(languages)), settings.smoothing)
    table[found["at"].to_numpy(), found["k"].to_numpy()] += found["n"].to_numpy()
    for i in range(len(settings.orders)):
        part = table[i * settings.features : (i + 1) * settings.features]
        part /= part.sum(axis=0)
    prior = np.log(np.array([seen[k] for k in languages], float))
    return Model(languages, np.log(table).astype(np.float32), prior - np.log(sum(seen.values())), settings)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability.

    Whole texts count, whatever their length.  Null texts and texts without any letter get
    ``und`` with score 0.  Other columns pass through unread; columns of the names that the
    result gets are replaced.  Repeated rows and null ids are scored like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in (lang_col, score_col)]
    rows = docs.select(*[col(c) for c in names])
    place = names.index(text_col)
    schema = StructType([*rows.schema.fields, StructField(lang_col, StringType()), StructField(score_col, DoubleType())])

    def score(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(place).to_pylist()
            lang, value = [], []
            for a, b in _pieces(texts):
                at, row, has = _grams(texts[a:b], m.settings)
                total = np.zeros((b - a, len(m.languages)))
                for i in range(0, len(at), PIECE):
                    r = row[i : i + PIECE]
                    begin = np.flatnonzero(np.diff(r, prepend=-1))
                    np.add.at(total, r[begin], np.add.reduceat(m.table[at[i : i + PIECE]], begin, axis=0, dtype=np.float64))
                total += m.prior
                if m.languages:
                    best = total.argmax(axis=1)
                    chance = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    lang += [m.languages[k] if h else UNKNOWN for k, h in zip(best.tolist(), has.tolist())]
                    value += np.where(has, chance, 0.0).tolist()
                else:
                    lang += [UNKNOWN] * (b - a)
                    value += [0.0] * (b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(value, pa.float64())], names=schema.names)

    return by_arrow(rows, score, schema)


def held_out(id_col: str = "doc_id"):
    """True for the third of the documents that training never reads."""
    return F.crc32(col(id_col).cast("string").cast("binary")) % 3 == 1


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) for every document, trained on the other two thirds."""
    test = F.coalesce(held_out(), F.lit(False))
    model = train(docs.filter(~test), settings)
    rows = docs.select("doc_id", test.alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, settings: Settings = Settings(), least_score: float = 0.5) -> DataFrame:
    """``docs`` without those whose language stays unknown or whose posterior is below ``least_score``."""
    model = train(docs.filter(~F.coalesce(held_out(), F.lit(False))), settings)
    pred, score = (fresh(docs.columns, name) for name in ("_lang_pred", "_lang_score"))
    rows = predict(docs, model, lang_col=pred, score_col=score)
    rows = rows.filter((F.col(pred) != UNKNOWN) & (F.col(score) >= least_score))
    return rows.select(*[col(c) for c in docs.columns])
