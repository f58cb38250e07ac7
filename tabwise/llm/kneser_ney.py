"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted arrays, memory-mapped by workers.

Counting shuffles per-task sorted counts in buckets.  The reducer of a bucket
stores its part of the model in the shared folder as sorted arrays:

* ``words-<b>``: word hashes, ascending; a word's number is its place over all buckets.
* ``counts-<b>``: how often each of these words occurs.
* ``pairs-<b>``, ``times-<b>``: bigrams as (context number << 32 | word number), ascending, and their counts.
* ``contexts-<b>``: for each context number of the bucket's range: total, and how many of its bigrams occur once, twice, more.
* ``before-<b>``: for each word number of the range, how many different contexts it follows.

Workers map these files and look words and bigrams up by binary search, so the
model may be larger than memory and nothing of it passes the driver but a few
sums a bucket and the rows of the most frequent contexts (at most HOT).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabwise.errors import PipelineError
from tabwise.llm.scratch import Scratch
from tabwise.llm.textarrays import mix, slices, text_bytes, words

#: Tokens that a bucket gets, about; tokens that a task gathers before it sends them on; text scored at a time.
BUCKET, FLUSH, SLICE = 1 << 22, 1 << 22, 1 << 22
#: A context with more than one in HOT of all tokens is spread over all buckets: fewer than HOT contexts.
HOT = 512


def local_folder(uri: str) -> str:
    """The path of a mounted folder; other stores cannot be memory-mapped."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise PipelineError(f"memory-mapped models need spark.checkpoint.dir on a mounted folder, not {parts.scheme}:")
    return parts.path


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Write then rename: a repeated task replaces the file by the same one."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}.npy"
    np.save(part, array)
    os.replace(part, f"{folder}/{name}.npy")


@dataclass
class Model:
    """What the driver knows of a stored model; workers map the arrays on first use."""

    folder: str
    bits: int
    sizes: list[int]                              # words of each hash bucket
    tokens: int = 0                               # N, ends included
    ends: int = 0                                 # training texts
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))      # numbers of the spread contexts, ascending
    hot_stats: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))
    pair_discounts: tuple = (0.5, 1.0, 1.5)
    word_discounts: tuple = (0.5, 1.0, 1.5)
    word_total: int = 0                           # different bigrams
    word_stats: tuple = (0, 0, 0)                 # words that follow one, two, more contexts

    def __post_init__(self):
        self.base = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self._files: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_files"} | {"_files": {}}

    @property
    def end(self) -> int:
        return int(self.base[-1])

    @property
    def begin(self) -> int:
        return self.end + 1

    @property
    def buckets(self) -> int:
        return len(self.sizes)

    def array(self, kind: str, bucket: int) -> np.ndarray:
        name = f"{kind}-{bucket}"
        if name not in self._files:
            path = f"{self.folder}/{name}.npy"
            self._files[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else np.zeros((0, 4) if kind == "contexts" else 0, np.int64)
        return self._files[name]

    def bounds(self, bucket: int) -> tuple[int, int]:
        """Number range of a bucket of contexts and words: begin and end belong to the last one."""
        low, high = self.base[bucket], self.base[bucket + 1]
        return int(low), int(high) + (2 if bucket == self.buckets - 1 else 0)

    def owner(self, number: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.base, number, "right") - 1, self.buckets - 1)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and training count of each word hash; -1 and 0 if unknown."""
        unique, inverse = np.unique(hashes, return_inverse=True)
        number, count = np.full(len(unique), -1, np.int64), np.zeros(len(unique), np.int64)
        cut = np.searchsorted(unique >> np.uint64(64 - self.bits), np.arange(self.buckets + 1, dtype=np.uint64))
        for b in range(self.buckets):
            own, known = unique[cut[b]:cut[b + 1]], self.array("words", b)
            if len(own) and len(known):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                same = known[at] == own
                number[cut[b]:cut[b + 1]] = np.where(same, at + self.base[b], -1)
                count[cut[b]:cut[b + 1]] = np.where(same, self.array("counts", b)[at], 0)
        return number[inverse], count[inverse]

    def pair_bucket(self, context: np.ndarray, key: np.ndarray) -> np.ndarray:
        bucket = self.owner(context)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            spread = self.hot[at] == context
            bucket[spread] = (mix(key[spread].astype(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)
        return bucket

    def by_number(self, kind: str, number: np.ndarray, width: int) -> np.ndarray:
        """Rows of the range arrays for numbers >= 0 (zeros for -1)."""
        out = np.zeros((len(number), width), np.int64)
        owner = np.where(number >= 0, self.owner(number), -1)
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            at = order[cut[b]:cut[b + 1]]
            if len(at):
                rows = self.array(kind, b)
                if len(rows):
                    out[at] = rows[number[at] - self.base[b]].reshape(-1, width)
        return out

    def times(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Training count of each bigram, 0 if unseen."""
        key = (context << 32) | np.maximum(word, 0)
        bucket = self.pair_bucket(context, key)
        order = np.lexsort((key, bucket))
        cut = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        out = np.zeros(len(key), np.int64)
        for b in range(self.buckets):
            at = order[cut[b]:cut[b + 1]]
            known = self.array("pairs", b)
            if len(at) and len(known):
                place = np.minimum(np.searchsorted(known, key[at]), len(known) - 1)
                out[at] = np.where(known[place] == key[at], self.array("times", b)[place], 0)
        return np.where((context >= 0) & (word >= 0), out, 0)

    def probabilities(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """p(word | context) for token numbers; -1 is an unknown word."""
        d1, d2, d3 = self.word_discounts
        follows = self.by_number("before", word, 1)[:, 0]
        kinds = self.end + (1 if self.ends else 0)
        uniform = 1.0 / (kinds + 1)
        if not self.word_total:
            return np.full(len(word), uniform)
        n1, n2, n3 = self.word_stats
        p = (follows - np.choose(np.minimum(follows, 3), (0.0, d1, d2, d3)) + (d1 * n1 + d2 * n2 + d3 * n3) * uniform) / self.word_total
        times = self.times(context, word)
        stats = self.by_number("contexts", context, 4)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            spread = self.hot[at] == context
            stats[spread] = self.hot_stats[at[spread]]
        d1, d2, d3 = self.pair_discounts
        total = np.maximum(stats[:, 0], 1)
        higher = (times - np.choose(np.minimum(times, 3), (0.0, d1, d2, d3))) / total
        back = (d1 * stats[:, 1] + d2 * stats[:, 2] + d3 * stats[:, 3]) / total
        return np.where(stats[:, 0] > 0, higher + back * p, p)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many n-grams occur 1, 2, 3 and 4 times."""
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2.0 * n[1])
    return tuple(min(k, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))


def _cut(keys: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, b in zip(edge[:-1], edge[1:]):
        yield int(bucket[a]), slice(a, b)


_COUNTS = pa.schema([("bucket", pa.int64()), ("high", pa.binary()), ("low", pa.binary()), ("n", pa.binary())])
_COUNTS_SQL = "bucket long, high binary, low binary, n binary"


def _packed(keys: np.ndarray, n: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """Sorted counts as one row a bucket, the halves of the keys apart (they compress better)."""
    rows = [(b, (keys[s] >> np.uint64(32)).astype(np.uint32).tobytes(), keys[s].astype(np.uint32).tobytes(), n[s].astype(np.uint32).tobytes())
            for b, s in _cut(keys, bucket)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [()] * 4, _COUNTS)], schema=_COUNTS)


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    half = lambda name: np.frombuffer(b"".join(table[name].to_pylist()), np.uint32)
    keys = (half("high").astype(np.uint64) << np.uint64(32)) | half("low")
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], half("n")[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


class _Counter:
    """Counts 64-bit keys in a task, merging as it goes."""

    def __init__(self, bucket_of):
        self.bucket_of, self.parts, self.held = bucket_of, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            self.parts.append(keys)
            self.held += len(keys)
            if self.held >= FLUSH:
                yield self.flush()

    def flush(self) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(self.parts), return_counts=True) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, int))
        self.parts, self.held = [], 0
        bucket = self.bucket_of(keys)
        order = np.lexsort((keys, bucket))
        return _packed(keys[order], n[order], bucket[order])


def train_kneser_ney(train: DataFrame, scratch: Scratch) -> Model:
    """Count the whole texts of ``train (text)`` and store the model under the scratch folder."""
    spark = scratch.spark
    folder = local_folder(scratch.path("model"))
    size = train.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    bits = max(3, ((size["b"] or 0) // 6 // BUCKET).bit_length())
    texts = train.select("text")

    def count_words(batches):
        counter = _Counter(lambda keys: (keys >> np.uint64(64 - bits)).astype(np.int64))
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in slices(offsets):
                part = offsets[a:b + 1]
                yield from counter.add(words(data[part[0]:part[-1]], part - part[0]).hashes)
        yield counter.flush()

    def store_words(table):
        bucket = table["bucket"][0].as_py()
        keys, n = _summed(table)
        _save(folder, f"words-{bucket}", keys)
        _save(folder, f"counts-{bucket}", n.astype(np.uint32) if n.max() < 1 << 32 else n)
        return pa.table({"bucket": [bucket], "size": [len(keys)], "tokens": [int(n.sum())],
                         "top": [[int(i) for i in np.argsort(-n, kind="stable")[:HOT]]], "top_n": [[int(n[i]) for i in np.argsort(-n, kind="stable")[:HOT]]]})

    kind = "bucket long, size long, tokens long, top array<long>, top_n array<long>"
    rows = texts.mapInArrow(count_words, _COUNTS_SQL).groupBy("bucket").applyInArrow(store_words, kind)
    rows = scratch.write(rows, "word-buckets")
    sums = {r["bucket"]: r for r in rows.select("bucket", "size", "tokens").collect()}
    model = Model(folder, bits, [sums[b]["size"] if b in sums else 0 for b in range(1 << bits)])
    model.ends = size["n"]
    model.tokens = sum(r["tokens"] for r in sums.values()) + model.ends
    # Each holds more than one in HOT of all tokens, so there are fewer than HOT of them.
    top = rows.select("bucket", F.explode(F.arrays_zip("top", "top_n")).alias("t")).where(F.col("t.top_n") * HOT > model.tokens).collect()
    model.hot = np.sort(np.array([model.base[r["bucket"]] + r["t"]["top"] for r in top] + [model.begin] * bool(model.ends), np.int64))
    _count_pairs(texts, model, scratch)
    return model


def token_numbers(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Context and word numbers of all tokens of some texts, training counts, and each text's first token."""
    w = words(data, offsets)
    number, count = model.numbers(w.hashes)
    rows = len(offsets) - 1
    last = w.first[1:] + np.arange(rows)                     # place of each text's end token
    total = len(number) + rows
    word, n = np.empty(total, np.int64), np.empty(total, np.int64)
    inner = np.ones(total, bool)
    inner[last] = False
    word[inner], n[inner] = number, count
    word[last], n[last] = model.end, model.ends
    context = np.concatenate([[model.begin], word[:-1]])
    first = w.first[:-1] + np.arange(rows)
    context[first] = model.begin
    return context, word, n, first


def _count_pairs(texts: DataFrame, model: Model, scratch: Scratch) -> None:
    shared = scratch.spark.sparkContext.broadcast(model)

    def count(batches):
        model = shared.value
        counter = _Counter(lambda keys: model.pair_bucket((keys >> np.uint64(32)).astype(np.int64), keys))
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in slices(offsets, SLICE):
                part = offsets[a:b + 1]
                context, word, _, _ = token_numbers(model, data[part[0]:part[-1]], part - part[0])
                yield from counter.add(((context << 32) | word).astype(np.uint64))
        yield counter.flush()

    def store(table):
        model, bucket = shared.value, table["bucket"][0].as_py()
        keys, n = _summed(table)
        _save(model.folder, f"pairs-{bucket}", keys.astype(np.int64))
        _save(model.folder, f"times-{bucket}", n.astype(np.uint8) if n.max() < 256 else n.astype(np.uint32))
        context = (keys >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        stats = np.stack([np.add.reduceat(x, first) for x in (n, n == 1, n == 2, n >= 3)], axis=1).astype(np.int64)
        own = context[first]
        spread = np.isin(own, model.hot)
        low, high = model.bounds(bucket)
        dense = np.zeros((high - low, 4), np.int64 if stats.max() >= 1 << 32 else np.uint32)
        dense[own[~spread] - low] = stats[~spread]
        _save(model.folder, f"contexts-{bucket}", dense)
        word, follows = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        owner = model.owner(word.astype(np.int64))
        part = _packed(word, follows, owner)
        rows = [{"bucket": b, "low": lo, "n": c, "numbers": None, "stats": None} for b, lo, c in zip(*(part.column(k).to_pylist() for k in (0, 2, 3)))]
        rows.append({"bucket": -1, "low": None, "n": None, "numbers": own[spread].tolist(), "stats": stats[spread].ravel().tolist()
                     + [int((n == k).sum()) for k in (1, 2, 3, 4)] + [len(keys)]})
        return pa.Table.from_pylist(rows, schema=pa.schema([("bucket", pa.int64()), ("low", pa.binary()), ("n", pa.binary()),
                                                            ("numbers", pa.list_(pa.int64())), ("stats", pa.list_(pa.int64()))]))

    rows = scratch.write(texts.mapInArrow(count, _COUNTS_SQL).groupBy("bucket").applyInArrow(
        store, "bucket long, low binary, n binary, numbers array<long>, stats array<long>"), "pair-buckets")
    hot, sums = {}, np.zeros(5, np.int64)
    for r in rows.where("bucket = -1").select("numbers", "stats").collect():     # one row a bucket
        stats = np.array(r["stats"], np.int64)
        sums += stats[-5:]
        for k, number in enumerate(r["numbers"]):
            hot[number] = hot.get(number, 0) + stats[4 * k:4 * k + 4]
    model.hot_stats = np.array([hot.get(k, np.zeros(4, np.int64)) for k in model.hot.tolist()], np.int64).reshape(-1, 4)
    model.pair_discounts, model.word_total = discounts(sums[:4].tolist()), int(sums[4])

    def store_words(table):
        model, bucket = shared.value, table["bucket"][0].as_py()
        low, high = model.bounds(bucket)
        word = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint32).astype(np.int64)
        follows = np.bincount(word - low, np.frombuffer(b"".join(table["n"].to_pylist()), np.uint32), minlength=high - low).astype(np.int64)
        _save(model.folder, f"before-{bucket}", follows.astype(np.uint32) if follows.max() < 1 << 32 else follows)
        return pa.table({"n": [[int((follows == k).sum()) for k in (1, 2, 3, 4)] + [int((follows >= 3).sum())]]})

    words_of = rows.where("bucket >= 0").select("bucket", "low", "n").groupBy("bucket").applyInArrow(store_words, "n array<long>")
    n = np.sum([r["n"] for r in words_of.collect()] or [[0] * 5], axis=0).tolist()     # one row a bucket
    model.word_discounts, model.word_stats = discounts(n[:4]), (n[0], n[1], n[4])
    scratch.drop("word-buckets", "pair-buckets")


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Words are runs of non-white-space, A-Z lower-cased; every text ends with
    one end token.  Null counts as empty: one end token.  ``base_score`` is the
    add-one unigram log10 probability, ``score`` the model's.  With nothing to
    learn from, every token has probability 1 in both.  Repeated rows score
    alike, null ids pass through, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kinds = model.end + (1 if model.ends else 0)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            parts = []
            for a, b in slices(offsets, SLICE):
                part = offsets[a:b + 1]
                context, word, n, first = token_numbers(model, data[part[0]:part[-1]], part - part[0])
                base = np.log10((n + 1.0) / (model.tokens + 1.0 * (kinds + 1)))
                own = np.log10(model.probabilities(context, word))
                parts.append(np.stack([np.diff(np.append(first, len(word))), np.add.reduceat(n > 0, first, dtype=np.int64),
                                       np.add.reduceat(base, first), np.add.reduceat(own, first)]))
            out = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0))
            yield pa.record_batch({
                "doc_id": batch.column(0), "n_tokens": pa.array(out[0].astype(np.int64)), "n_known": pa.array(out[1].astype(np.int64)),
                "train_tokens": pa.array(np.full(out.shape[1], model.tokens, np.int64)), "base_score": pa.array(out[2]),
                "score": pa.array(out[3]), "perplexity": pa.array(10.0 ** np.minimum(300.0, -out[3] / np.maximum(out[0], 1)))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def evaluate(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learn from the rows of ``docs`` that are not ``held_out``; score every row."""
    scratch = Scratch(docs.sparkSession, "kneser-ney")
    model = train_kneser_ney(docs.where(~held_out), scratch)
    return score_texts(docs, model).withColumn("held_out", held_out)
