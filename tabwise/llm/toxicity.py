"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary and one of toxic text.

A window of toxic text becomes shorter with the toxic dictionary than with the
ordinary one.  The ordinary dictionary is trained on windows of ordinary text.
The toxic one has the same ordinary part, so that plain language costs the same
with both, and in addition the segments that set the toxic training texts apart:
byte n-grams that occur in many of them and in hardly any ordinary text.  The
ordinary dictionary has neutral bytes in that place, so both are of one length.
A logistic model on the windows' length differences, fitted on sampled texts
that the dictionaries have not seen, gives calibrated scores; it also chooses
how many segments the toxic dictionary gets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tabwise.llm.language_id import remainder
from tabwise.llm.sampling import smallest_hashes
from tabwise.llm.textarrays import LOWER, text_bytes

#: Sampled training texts of each class, at most, and their greatest length in code points; every third calibrates.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_LENGTH = 1500, 3000, 32_768
WINDOW, LEVEL, BASE_BYTES = 128, 6, 32_768
SEGMENT_SIZES, SEGMENT_COUNTS = (5, 6, 8), (16, 32, 64, 128)
#: A segment is in this many toxic training texts at least, and this many times likelier there.
MIN_TEXTS, MIN_RATIO = 4, 8.0

_WINDOWS = re.compile(rb"(?s).{%d}[^\x00-\x20]{0,64}|.+" % WINDOW)


def _lower(text: str | None) -> bytes:
    return LOWER[np.frombuffer((text or "").encode(), np.uint8)].tobytes()


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class ToxicityModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    centre: np.ndarray = field(default_factory=lambda: np.zeros(6))
    scale: np.ndarray = field(default_factory=lambda: np.ones(6))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(7))
    constant: float | None = 0.0     #: the score of every text when there was nothing to tell apart

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def features(self, text: bytes) -> np.ndarray:
        """How much shorter the windows of a lower-cased text become with the toxic dictionary."""
        if self._pair is None:
            self._pair = _compressor(self.ordinary), _compressor(self.toxic)
        plain, toxic = self._pair[0].compress, self._pair[1].compress
        d = np.array([len(plain(w)) - len(toxic(w)) for w in _WINDOWS.findall(text)] or [0], float)
        most = np.sort(d)[::-1][:3]
        return np.array([d.mean(), most[0], most.mean(), np.log1p((d >= 2).sum()), np.log1p(np.maximum(d - 1, 0).sum()), (d >= 2).mean()])

    def score(self, text: bytes) -> float:
        if self.constant is not None:
            return self.constant
        z = float((self.features(text) - self.centre) / self.scale @ self.weights[:-1] + self.weights[-1])
        return 1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0)))


def _segment_counts(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte n-grams (white space as a space) and in how many of the texts each occurs."""
    found = []
    for text in texts:
        b = np.frombuffer(text, np.uint8)
        b = np.where(b < 33, 32, b).astype(np.uint64)
        grams = np.zeros(max(0, len(b) - size + 1), np.uint64)
        for k in range(size if len(grams) else 0):
            grams = (grams << np.uint64(8)) | b[k:k + len(grams)]
        found.append(np.unique(grams))
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))


def contrast_segments(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Segments that set toxic from ordinary texts apart, by falling log-likelihood ratio, without overlapping ones."""
    candidates = []
    for size in SEGMENT_SIZES:
        grams, n = _segment_counts(toxic, size)
        grams, n = grams[n >= MIN_TEXTS], n[n >= MIN_TEXTS].astype(float)
        others, m = _segment_counts(ordinary, size)
        at = np.minimum(np.searchsorted(others, grams), max(0, len(others) - 1))
        m = np.where(others[at] == grams, m[at], 0).astype(float) if len(others) else np.zeros(len(grams))
        a, b = len(toxic), max(1, len(ordinary))
        p, q, both = n / a, m / b, (n + m) / (a + b)
        gain = lambda x, y: np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / y), 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 * a * (gain(p, both) + gain(1 - p, 1 - both)) + 2 * b * (gain(q, both) + gain(1 - q, 1 - both))
        keep = (p + 0.5 / a) / (q + 0.5 / b) >= MIN_RATIO
        candidates += [(-score, int(x).to_bytes(8, "big")[8 - size:].strip()) for x, score in zip(grams[keep].tolist(), g[keep].tolist())]
    chosen: list[bytes] = []
    for _, s in sorted(candidates):
        if len(chosen) >= max(SEGMENT_COUNTS):
            break
        if len(s) >= 4 and not any(x in s or s in x or part in x or other in s
                                   for x in chosen for part, other in ((s[:4], x[:4]), (s[-4:], x[-4:]))):
            chosen.append(s)
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last for the constant) of a slightly regularised logistic fit, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[int, int, str | None]]) -> ToxicityModel:
    """Fit on sampled rows (label, rank, text); with only one class, every score is 0 or 1."""
    if len({label for label, _, _ in rows}) < 2:
        return ToxicityModel(constant=float(rows[0][0]) if rows else 0.0)
    learn = [(y, _lower(t)) for y, k, t in rows if k % 3] or [(y, _lower(t)) for y, k, t in rows]
    check = [(y, _lower(t)) for y, k, t in rows if not k % 3]
    if len({y for y, _ in check}) < 2:
        check = learn
    ordinary = [t for y, t in learn if not y]
    samples = [w for t in ordinary for w in re.findall(rb"(?s).{1,256}", t)]
    try:
        base = zstandard.train_dictionary(BASE_BYTES, samples, k=64, d=8, level=3).as_bytes()
    except zstandard.ZstdError:        # too little text for training: the text itself
        base = b"".join(samples)[:BASE_BYTES]
    segments = contrast_segments([t for y, t in learn if y], ordinary)
    y, best = np.array([y for y, _ in check], float), None
    for count in SEGMENT_COUNTS:
        extra = b"".join(s + b"Z" for s in segments[:count])       # texts are lower-case: "Z" matches nothing
        model = ToxicityModel(base + b"Z" * len(extra), base + extra, constant=None)
        x = np.array([model.features(t) for _, t in check])
        model.centre, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        model.weights = _logistic((x - model.centre) / model.scale, y)
        p = np.clip(1.0 / (1.0 + np.exp(-((x - model.centre) / model.scale @ model.weights[:-1] + model.weights[-1]))), 1e-6, 1 - 1e-6)
        loss = -float((y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        if best is None or loss < best[0]:
            best = loss, model
    return best[1]


def train_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on a bounded sample of ``labels (doc_id, toxic)``, joined to the texts of ``docs``.

    The sample is drawn from the thin label table; its ids (at most
    SAMPLE_TOXIC + SAMPLE_ORDINARY) are broadcast, so no text is shuffled.
    A document with several labels counts as toxic if one says so; null labels
    and ids teach nothing.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = smallest_hashes(known.where("toxic = 1"), "toxic", SAMPLE_TOXIC, F.col("doc_id")).unionByName(
        smallest_hashes(known.where("toxic = 0"), "toxic", SAMPLE_ORDINARY, F.col("doc_id")))
    ids = [(r["doc_id"], r["toxic"], r["_rank"]) for r in chosen.select("doc_id", "toxic", "_rank").collect()]
    if not ids:
        return ToxicityModel()
    wanted = docs.sparkSession.createDataFrame(ids, "_id long, toxic int, _rank int")
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.char_length("text") <= SAMPLE_LENGTH)
             .join(F.broadcast(wanted), F.col("doc_id") == F.col("_id")).dropDuplicates(["_id"]))
    return fit([(r["toxic"], r["_rank"], r["text"]) for r in texts.select("toxic", "_rank", "text").orderBy("toxic", "_rank").collect()])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: doc_id, score, predicted (1 if score >= 0.5).

    Every window of the whole text counts; null and empty texts have one empty
    window.  Repeated rows score alike, null ids pass through, an empty table
    gives no rows, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)     # two dictionaries of about BASE_BYTES

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            data = LOWER[data].tobytes()
            s = [shared.value.score(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(s, pa.float64()),
                                   "predicted": pa.array([int(x >= 0.5) for x in s], pa.int32())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double, predicted int")


def evaluate(docs: DataFrame, labels: DataFrame, divisor: int = 5, held: int = 0) -> DataFrame:
    """Learn from labels of rows whose crc32(doc_id) mod ``divisor`` is not ``held``; score every row of ``docs``."""
    model = train_toxicity(docs, labels.where(remainder(F.col("doc_id"), divisor) != held))
    held_out = (remainder(F.col("doc_id"), divisor) == held).alias("held_out")
    return score_toxicity(docs, model).select("doc_id", held_out, "score", "predicted")
