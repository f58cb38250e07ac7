"""Benchmark decontamination with suffix arrays of the training text.

Each task sorts the word suffixes of its documents into suffix arrays, one for
each shard of a few MB.  Every benchmark suffix is looked up by binary search:
the range of training suffixes that begin with its window gives the verbatim
matches and their places.  A suffix whose window holds a word that the
benchmark never uses can match nothing, so it is left out before sorting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabwise.llm.textarrays import NON_ALNUM, slices, text_bytes, words

WINDOW = 13
#: Benchmark text held by a task at a time.  A larger benchmark is looked up in blocks of this size.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20

_SCHEMA = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
           "items array<string>, hit_spans array<struct<first: int, words: int>>")


class TestSuffixes:
    """The distinct windows of some benchmark items, by length, as keys to look up in suffix arrays."""

    __test__ = False  # not a pytest class

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        w = words(data, offsets, NON_ALNUM)
        self.vocabulary = np.unique(w.hashes)
        code = (np.searchsorted(self.vocabulary, w.hashes) + 1).astype(">u4")
        self.ids, found = ids, {}
        for item, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
            size = min(window, b - a)
            for at in range(a, b - size + 1) if size else ():
                found.setdefault(size, {}).setdefault(code[at:at + size].tobytes(), set()).add(item)
        #: length -> (sorted keys, items of each key)
        self.windows = {}
        for size, keys in found.items():
            ordered = sorted(keys)
            self.windows[size] = (np.array(ordered, dtype=f"S{4 * size}"), [sorted(keys[k]) for k in ordered])


def _shard(w, vocabulary: np.ndarray, windows: dict, hit: np.ndarray, items: dict[int, set]) -> None:
    """Look all windows up in the suffix arrays of one shard; mark hit words, collect items by row."""
    if not len(w.hashes) or not len(vocabulary):
        return
    at = np.minimum(np.searchsorted(vocabulary, w.hashes), len(vocabulary) - 1)
    known = vocabulary[at] == w.hashes
    code = np.where(known, at + 1, 0).astype(">u4")
    # how many known words of the same text begin at each word
    stop = np.flatnonzero(~known)
    text_end = np.repeat(w.first[1:], np.diff(w.first))
    index = np.arange(len(code))
    following = np.searchsorted(stop, index)
    run = np.minimum(text_end, np.append(stop, len(code))[following]) - index
    cover = np.zeros(len(code) + 1, dtype=np.int64)
    for size, (keys, owners) in windows.items():
        suffix = np.flatnonzero(run >= size)
        if not len(suffix):
            continue
        rows = code[suffix[:, None] + np.arange(size)]
        text = np.ascontiguousarray(rows).view(f"S{4 * size}").ravel()
        order = np.argsort(text, kind="stable")
        array = text[order]                                    # the suffix array, to this depth
        low, high = np.searchsorted(array, keys, "left"), np.searchsorted(array, keys, "right")
        for key in np.flatnonzero(high > low):
            places = suffix[order[low[key]:high[key]]]
            np.add.at(cover, places, 1)
            np.add.at(cover, places + size, -1)
            for row in np.unique(np.searchsorted(w.first, places, "right") - 1).tolist():
                items.setdefault(row, set()).update(owners[key])
    hit |= np.cumsum(cover[:-1]) > 0


def _blocks(benchmark: DataFrame, window: int) -> list:
    """The benchmark as broadcast blocks of about BLOCK_BYTES of text."""
    spark = benchmark.sparkSession
    sized = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text").where("text IS NOT NULL")
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_BYTES))
    blocks = []
    for k in range(n_blocks):
        rows = sized.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k).distinct().collect()
        blocks.append(spark.sparkContext.broadcast(TestSuffixes([r["id"] for r in rows], [r["text"] for r in rows], window)))
    return blocks


def _judge(column: pa.Array, blocks: list, percent: int) -> dict[str, list]:
    """Per text of the column: words, hit words, sorted items, spans of hit words, contaminated."""
    data, offsets = text_bytes(column)
    out = {name: [] for name in ("n_words", "n_hit", "items", "spans", "contaminated")}
    for a, b in slices(offsets, SHARD_BYTES):
        part = offsets[a:b + 1]
        w = words(data[part[0]:part[-1]], part - part[0], NON_ALNUM)
        hit, names = np.zeros(len(w.hashes), dtype=bool), {}
        for block in blocks:
            test, found = block.value, {}
            _shard(w, test.vocabulary, test.windows, hit, found)
            for row, items in found.items():
                names.setdefault(row, set()).update(test.ids[i] for i in items)
        for row in range(b - a):
            mask = hit[w.first[row]:w.first[row + 1]]
            n_hit = int(mask.sum())
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))) if n_hit else ()
            out["n_words"].append(len(mask))
            out["n_hit"].append(n_hit)
            out["items"].append(sorted(names.get(row, ())))
            out["spans"].append([{"first": int(x), "words": int(y - x)} for x, y in zip(edge[::2], edge[1::2])])
            out["contaminated"].append(n_hit > 0 and 100 * n_hit >= percent * len(mask))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: counts, items found and the places of hit words.

    Words are lower-cased runs of digits, letters and non-ASCII characters.  A
    benchmark item of fewer words than ``window``, but not none, is one window.
    ``n_hit`` counts the words inside any occurrence of a window, ``hit_spans``
    lists those runs (first word, number of words), ``items`` the item_ids with
    occurring windows as sorted strings; ``contaminated``: n_hit > 0 and at
    least ``percent`` per cent of the words.  Null or empty texts have no words
    and are clean; null and empty items have no window, a null item_id counts
    as the id "".  Repeated rows are judged alike; an empty table gives no
    rows, an empty benchmark finds nothing.  Other columns are not read.

    Documents are not shuffled and never cut: a document's words stay in one
    shard.  The benchmark is sent to the tasks in blocks of BLOCK_BYTES.
    """
    blocks = _blocks(benchmark, window)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _judge(batch.column(1), blocks, percent)
            yield pa.record_batch({
                "doc_id": batch.column(0), "n_words": pa.array(out["n_words"], pa.int64()), "n_hit": pa.array(out["n_hit"], pa.int64()),
                "n_items": pa.array([len(x) for x in out["items"]], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in out["items"]], pa.string()),
                "contaminated": pa.array(out["contaminated"], pa.bool_()),
                "items": pa.array(out["items"], pa.list_(pa.string())),
                "hit_spans": pa.array(out["spans"], pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())])))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, _SCHEMA)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; one pass, no shuffle."""
    blocks, at = _blocks(benchmark, window), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not x for x in _judge(batch.column(at), blocks, percent)["contaminated"]], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
