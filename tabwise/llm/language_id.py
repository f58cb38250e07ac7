"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of lower-cased code points, sublinear term
frequency times inverse document frequency, scaled to length one.  Document
frequencies count every training text (one Spark aggregation).  The weights
come from follow-the-regularised-leader (FTRL-proximal) with an elastic net on
a bounded sample of training texts, and a temperature, fitted on a part of the
sample that the weights have not seen, calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabwise.llm.sampling import smallest_hashes
from tabwise.llm.textarrays import slices, text_bytes

FEATURES = 1 << 15
#: Sampled training texts of each language, at most; every fifth calibrates.
SAMPLE_PER_LANGUAGE = 600
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 0.1
UNDETERMINED = "und"

_PLAIN = np.arange(0x80, dtype=np.uint32)
_PLAIN[[c for c in range(0x80) if not chr(c).isalpha()]] = 0x20


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the whole text, ascending, and how often each occurs."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    low = c < 0x80
    c = np.where(low, _PLAIN[np.where(low, c, 0)], c)
    c = np.concatenate([[0x20], c, [0x20]]).astype(np.uint32)
    one, two, three = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    pair = c[:-1] * two + c[1:] * one + np.uint32(1)
    triple = pair[:-1] * three + c[2:] * one + np.uint32(2)
    grams = np.concatenate([c * one, pair, triple])
    grams = ((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    counts = np.bincount(grams, minlength=FEATURES)
    index = np.flatnonzero(counts)
    return index.astype(np.int32), counts[index]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray            # FEATURES
    weights: np.ndarray        # FEATURES + 1 (bias) x languages
    temperature: float = 1.0

    def vector(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1.0 + np.log(counts)) * self.idf[index]
        norm = float(np.sqrt(x @ x))
        return x / norm if norm else x

    def probabilities(self, index: np.ndarray, counts: np.ndarray, temperature: float | None = None) -> np.ndarray:
        z = (self.vector(index, counts) @ self.weights[index] + self.weights[-1]) / (temperature or self.temperature)
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        p = self.probabilities(*term_counts(text))
        return self.languages[int(p.argmax())], float(p.max())


def _ftrl(model: LanguageModel, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """Fit ``model.weights`` by per-coordinate FTRL-proximal with l1 and l2 penalties (none on the bias)."""
    classes = len(model.languages)
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))
    order = np.random.default_rng(7)

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    vectors = [(y, np.append(i, FEATURES), np.append(model.vector(i, c), 1.0)) for y, i, c in rows]
    for _ in range(EPOCHS):
        for k in order.permutation(len(vectors)):
            y, at, x = vectors[k]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    model.weights = weights(np.arange(FEATURES + 1)).astype(np.float32)


def _temperature(model: LanguageModel, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> float:
    """The temperature between 1/4 and 4 of least log loss on unseen rows."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(4.0), 25))
    if not rows:
        return 1.0
    loss = [sum(-np.log(max(model.probabilities(i, c, t)[y], 1e-12)) for y, i, c in rows) for t in grid]
    return float(grid[int(np.argmin(loss))])


def train_language_model(labelled: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on ``labelled (doc_id, text, lang)``; rows without text, letters or lang teach nothing."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select(
        F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("_h"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                index, _ = term_counts(text.as_py())
                df[index] += 1
                n += 1
        at = np.append(np.flatnonzero(df), FEATURES)       # the last row counts the texts
        yield pa.record_batch({"feature": pa.array(at, pa.int64()), "n": pa.array(np.append(df, n)[at], pa.int64())})

    df = rows.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(FEATURES + 1)
    counts[df["feature"].to_numpy()] = df["n"].to_numpy()
    idf = (np.log((1.0 + counts[-1]) / (1.0 + counts[:-1])) + 1.0).astype(np.float32)

    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], idf, np.zeros((FEATURES + 1, 0), np.float32))
    sample = smallest_hashes(rows, "lang", sample_per_language, F.col("_h")).select("lang", "_rank", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_counts(t.as_py()) for t in batch.column(2)]
            yield pa.record_batch({"lang": batch.column(0), "rank": batch.column(1).cast(pa.int64()),
                                   "at": pa.array([i.tobytes() for i, _ in found], pa.binary()),
                                   "n": pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())})

    got = sample.mapInArrow(features, "lang string, rank long, at binary, n binary").toPandas().sort_values(["rank", "lang"])
    data = [(languages.index(r.lang), np.frombuffer(r.at, np.int32), np.frombuffer(r.n, np.int32)) for r in got.itertuples()]
    model = LanguageModel(languages, idf, np.zeros((FEATURES + 1, len(languages)), np.float32))
    held = [r for r, k in zip(data, got["rank"]) if k % 5 == 0]
    _ftrl(model, [r for r, k in zip(data, got["rank"]) if k % 5 != 0] or data)
    model.temperature = _temperature(model, held)
    return model


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: doc_id, lang_pred, score.

    The whole text is read.  Null texts and texts without a letter are
    ``und`` with score 0, as is everything when there was nothing to learn
    from.  Repeated rows are judged alike; an empty table gives no rows; null
    ids pass through; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)     # FEATURES x languages floats

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch({"doc_id": batch.column(0), "lang_pred": pa.array([x for x, _ in found], pa.string()),
                                   "score": pa.array([s for _, s in found], pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, least_score: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is determined with at least ``least_score``; one pass.

    Rows are passed on in pieces of about SLICE_BYTES, so neither side holds a whole batch of long texts twice.
    A model that had nothing to learn from rejects nothing.
    """
    if not model.languages:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(at))
            for a, b in slices(offsets):
                piece = batch.slice(a, b - a)
                found = [shared.value.predict(t.as_py()) for t in piece.column(at)]
                yield piece.filter(pa.array([x != UNDETERMINED and s >= least_score for x, s in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def evaluate(docs: DataFrame, divisor: int = 3, held: int = 1) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod ``divisor`` is not ``held``; predict every row of ``docs``."""
    held_out = remainder(F.col("doc_id"), divisor) == held
    model = train_language_model(docs.where(~held_out))
    return identify_languages(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")
