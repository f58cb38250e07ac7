"""Exact n-gram Jaccard join with set-relation skipping.

Every document is its set of distinct word n-grams.  Equal sets are one set
from the start.  Two sets can only be similar when they share one of the first
``n - ceil(t n) + 1`` n-grams in any common order, so an inverted index over
those prefixes finds every candidate.  Two kinds of skipping keep it small:

* Index lists are sorted by set size and position.  Of a list, only the sets
  whose size fits are visited, and pairs whose positions leave too little overlap
  are dropped; lists whose sets are connected already are skipped whole.
  How many prefix n-grams two sets share then bounds their overlap once more.
* Answers are derived from a highly similar set.  First every set is compared
  with two leaders only: its neighbour and the hub in most of its lists.
  Sets that turn out connected need no comparison with each other.  For the
  pairs that are left, a follower's overlap is bounded by its leader's computed
  answer plus the few n-grams that it does not share with the leader, and only
  pairs that this bound cannot rule out are compared.
* A parity sketch of each set (one bit a slot: whether an odd number of its
  n-grams fall there) bounds the overlap from above: two sets differ in at least
  as many n-grams as their sketches differ in bits.

N-grams are compared as 64-bit hashes, sets are named by 128-bit digests.
Frequent n-grams come last in the order: those that hold more than one in
``MAX_HEAVY`` of all n-grams, counted over all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabwise.llm.components import connected_components
from tabwise.llm.scratch import Scratch
from tabwise.llm.textarrays import shingle_sets

#: Bound for the broadcast table of frequent n-grams, and the least document frequency that counts as frequent.
MAX_HEAVY, MIN_HEAVY = 1 << 22, 32
#: N-grams that a task gathers before it sends them on, and about how many one index bucket gets.
FLUSH, BUCKET = 1 << 20, 1 << 20
#: Bits of a set's parity sketch.
SKETCH = 512
#: Bits of the map that tells which texts may be compared (1 MB).
BITMAP = 1 << 23

_V16 = np.dtype("V16")


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _prefix(n: int, percent: int) -> int:
    return n + 1 - (percent * n + 99) // 100


def _needed(a, b, percent: int):
    """The least overlap of two similar sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def _sketch(tokens: np.ndarray) -> bytes:
    """For each of SKETCH slots, whether an odd number of the set's n-grams fall there."""
    slots = np.bincount((tokens % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    return np.packbits((slots & 1).astype(np.uint8)).tobytes()


def _blob(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def set_profiles(docs: DataFrame, size: int, key: Column | None = None) -> DataFrame:
    """(doc_id, n, set_id): size and digest of every document's set (set_id null if empty), and the row's key if there is one."""
    def profile(batches):
        for batch in batches:
            sets = [(len(s), _digest(s) if len(s) else None) for _, s in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in sets], pa.int64()), pa.array([d for _, d in sets], pa.binary()),
                                              *batch.columns[2:]], names=["doc_id", "n", "set_id", *batch.schema.names[2:]])

    rows = docs.select(F.col("doc_id").cast("long"), "text", *([] if key is None else [key.alias("key")]))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set_id", T.BinaryType()),
                           *rows.schema.fields[2:]])
    return rows.mapInArrow(profile, schema)


def _distinct_sets(batches, size: int) -> Iterator[tuple[bytes, np.ndarray, object]]:
    """(digest, tokens, text) of each set that this task has not seen before."""
    seen = set()
    for batch in batches:
        column = batch.column(0)
        for row, tokens in shingle_sets(column, size):
            if len(tokens) and (digest := _digest(tokens)) not in seen:
                seen.add(digest)
                yield digest, tokens, column[row]


def frequent_tokens(docs: DataFrame, size: int, total: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (top ``bits + 32`` bits) and counts of the frequent n-grams: fewer than MAX_HEAVY, as each
    holds more than that share of all ``total``.  Tasks send sorted counts in hash buckets."""
    least = max(MIN_HEAVY, total // MAX_HEAVY + 1)
    schema = pa.schema([("bucket", pa.int64()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(parts) >> np.uint64(32 - bits), return_counts=True)
        bucket, low = (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        rows = []
        for a, b in zip(cut[:-1], cut[1:]):
            many = counts[a:b] > 1
            rows.append((int(bucket[a]), _blob(low[a:b][~many]), _blob(low[a:b][many]), _blob(counts[a:b][many].astype(np.uint32))))
        return _table(schema, rows)

    def count(batches):
        parts, held = [], 0
        for _, tokens, _ in _distinct_sets(batches, size):
            parts.append(tokens)
            held += len(tokens)
            if held >= FLUSH:
                yield flush(parts)
                parts, held = [], 0
        if parts:
            yield flush(parts)

    def merge(table: pa.Table) -> pa.Table:
        column = lambda name: np.frombuffer(b"".join(table[name].to_pylist()), np.uint32)
        once = column("once")
        keys = np.concatenate([once, column("more")])
        weight = np.concatenate([np.ones(len(once), np.int64), column("counts").astype(np.int64)])
        order = np.argsort(keys, kind="stable")
        keys, weight = keys[order], weight[order]
        cut = np.flatnonzero(np.diff(keys.astype(np.int64), prepend=-1))
        sums = np.add.reduceat(weight, cut) if len(cut) else weight
        many = sums >= least
        bucket = table["bucket"][0].as_py()
        return pa.table({"key": pa.array((bucket << 32) + keys[cut][many].astype(np.int64), pa.int64()), "n": pa.array(sums[many], pa.int64())})

    heavy = (docs.select("text").mapInArrow(count, "bucket long, once binary, more binary, counts binary")
             .groupBy("bucket").applyInArrow(merge, "key long, n long").toPandas().sort_values("key"))
    return heavy["key"].to_numpy(np.uint64), heavy["n"].to_numpy(np.int64)


_LISTS = pa.schema([("bucket", pa.int64()), ("sets", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()),
                    ("members", pa.binary()), ("places", pa.binary())])
_LISTS_SQL = "bucket long, sets binary, sizes binary, keys binary, members binary, places binary"


def prefix_postings(docs: DataFrame, size: int, percent: int, bits: int, heavy, heavy_counts) -> DataFrame:
    """Index postings (n-gram, set, position) of all prefixes, packed by hash bucket."""

    def flush(digests, sizes, keys, members, places) -> pa.RecordBatch:
        sets, sizes = np.frombuffer(b"".join(digests), _V16), np.array(sizes, np.uint32)
        key = np.concatenate(keys)
        member = np.repeat(np.arange(len(members), dtype=np.uint32), members)
        order = np.argsort(key, kind="stable")
        key, member, place = key[order], member[order], np.concatenate(places)[order]
        bucket = (key >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        rows = []
        for a, b in zip(cut[:-1], cut[1:]):
            own, index = np.unique(member[a:b], return_inverse=True)
            rows.append((int(bucket[a]), _blob(sets[own]), _blob(sizes[own]), _blob(key[a:b].astype(np.uint32)),
                         _blob(index.astype(np.uint32)), _blob(place[a:b])))
        return _table(_LISTS, rows)

    def post(batches):
        frequent, counts = heavy.value, heavy_counts.value
        state, held = ([], [], [], [], []), 0
        for digest, tokens, _ in _distinct_sets(batches, size):
            key, p = tokens >> np.uint64(32 - bits), _prefix(len(tokens), percent)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
                weight = np.where(frequent[at] == key, counts[at], 0)
                if weight.any():
                    key = key[np.argsort(weight, kind="stable")]
            for column, value in zip(state, (digest, len(tokens), key[:p], p, np.arange(p, dtype=np.uint32))):
                column.append(value)
            held += p
            if held >= FLUSH:
                yield flush(*state)
                state, held = ([], [], [], [], []), 0
        if held:
            yield flush(*state)

    return docs.select("text").mapInArrow(post, _LISTS_SQL)


def _merge_lists(table: pa.Table) -> pa.Table:
    """One bucket's postings as lists sorted by n-gram, set size and position; lists of one set are dropped."""
    column = lambda name, kind: [np.frombuffer(x, kind) for x in table[name].to_pylist()]
    sets, members = column("sets", _V16), column("members", np.uint32)
    base = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.uint32)
    names, first, same = np.unique(np.concatenate(sets).astype("V16").view("S16"), return_index=True, return_inverse=True)
    size, same = np.concatenate(column("sizes", np.uint32))[first], same.astype(np.uint32)
    member = same[np.concatenate([m + b for m, b in zip(members, base)])]
    del sets, members, same
    key, place = np.concatenate(column("keys", np.uint32)), np.concatenate(column("places", np.uint32))
    order = np.lexsort((member, place, size[member], key))
    key, member, place = key[order], member[order], place[order]
    del order
    new = np.ones(len(key), bool)      # copies from different tasks are one posting
    new[1:] = (key[1:] != key[:-1]) | (member[1:] != member[:-1])
    key, member, place = key[new], member[new], place[new]
    ends = np.ones(len(key) + 1, bool)     # of lists: those of one posting are dropped
    ends[1:-1] = key[1:] != key[:-1]
    shared = ~(ends[:-1] & ends[1:])
    key, member, place = key[shared], member[shared], place[shared]
    own, index = np.unique(member, return_inverse=True)
    raw = names.astype("S16").view("V16")
    return pa.Table.from_batches([_table(_LISTS, [(
        table["bucket"][0].as_py(), _blob(raw[own]), _blob(size[own]), _blob(key), _blob(index.astype(np.uint32)), _blob(place))]
        if len(key) else [])], schema=_LISTS)


class _Lists:
    """One bucket's lists as arrays: list number, set, set size and position of each posting."""

    def __init__(self, row: dict):
        self.sets = np.frombuffer(row["sets"], _V16)
        self.member = np.frombuffer(row["members"], np.uint32).astype(np.int64)
        self.size = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)[self.member]
        self.place = np.frombuffer(row["places"], np.uint32).astype(np.int64)
        self.list = np.cumsum(np.diff(np.frombuffer(row["keys"], np.uint32).astype(np.int64), prepend=-1) != 0)


class _Sets(NamedTuple):
    """What is known of a bucket's sets."""

    degree: np.ndarray     #: lists it is in, over all buckets
    group: np.ndarray      #: component so far
    hub: np.ndarray        #: the hub it was compared with
    overlap: np.ndarray    #: and the computed overlap with that; -1 if the hub is the set itself
    sketch: np.ndarray     #: parity sketch as SKETCH / 64 integers


def _possible(x: _Lists, degree: np.ndarray, one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sets of two postings of a list can be similar.

    By position: they have as many common n-grams before this one as the
    earlier position allows, and all that follows it.  By degree: in the
    prefixes they share at most the lists of the set that is in fewer, and
    after them at most the rest of one set.
    """
    a, b, i, j = x.size[one], x.size[other], x.place[one], x.place[other]
    needed, large = _needed(a, b, percent), np.maximum(a, b)
    shared = np.minimum(degree[x.member[one]], degree[x.member[other]])
    return ((100 * np.minimum(a, b) >= percent * large) & (np.minimum(i, j) + np.minimum(a - i, b - j) >= needed)
            & (shared + (percent * large + 99) // 100 - 1 >= needed))


def _derivable(x: _Lists, sets: _Sets, one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Whether two postings' sets can be similar, by their answers for a hub that both were compared with.

    They share at most what either shares with the hub, and of what is outside
    the hub the lesser part.  Prefix n-grams that no other prefix has are no
    common ones, for that set of the two whose prefix ends first; the hub may
    hold them behind its own prefix, so they are taken off the whole set only.
    """
    a, b = x.member[one], x.member[other]
    with_hub, out, common = [], [], []
    for m, size in ((a, x.size[one]), (b, x.size[other])):
        o = np.where(sets.overlap[m] < 0, size, sets.overlap[m])
        with_hub.append(o)
        out.append(size - o)
        common.append(size - (_prefix(size, percent) - sets.degree[m]))
    bound = np.minimum(np.minimum(*with_hub) + np.minimum(*out), np.maximum(*common))
    return (sets.hub[a] != sets.hub[b]) | (bound >= _needed(x.size[one], x.size[other], percent))


def list_degrees(lists: DataFrame) -> DataFrame:
    """(set_id, degree): in how many lists each set is, that is, how many of its prefix n-grams others have too."""
    kind = pa.schema([("set_id", pa.binary()), ("degree", pa.int64())])

    def degrees(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = _Lists(row)
                yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in x.sets], pa.binary()),
                                                  pa.array(np.bincount(x.member, minlength=len(x.sets)), pa.int64())], schema=kind)

    return lists.mapInArrow(degrees, "set_id binary, degree long").groupBy("set_id").agg(F.sum("degree").alias("degree"))


def _with_sets(lists: DataFrame, known: DataFrame, fn, schema: pa.Schema, sql: str) -> DataFrame:
    """Apply ``fn(lists, sets, names)`` to each bucket; ``known (set_id, degree, component, hub, overlap, sketch)`` of all listed sets
    (sketches are null where ``fn`` does not use them)."""
    kind = pa.schema([("bucket", pa.int64()), ("set_id", pa.binary())])

    def own_sets(batches):
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sets = np.frombuffer(blob, _V16)
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(sets), pa.int64()),
                                                  pa.array([s.tobytes() for s in sets], pa.binary())], schema=kind)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        of = dict(zip(right["set_id"].to_pylist(), zip(*(right[c].to_pylist() for c in ("degree", "component", "hub", "overlap", "sketch")))))
        out = [_table(schema, [])]
        for row in left.to_pylist():
            x = _Lists(row)
            names = [s.tobytes() for s in x.sets]
            number: dict[bytes, int] = {}
            group = np.array([number.setdefault(of[s][1], len(number)) for s in names])
            hub = np.array([number.setdefault(of[s][2], len(number)) for s in names])
            sketch = np.frombuffer(b"".join(of[s][4] or bytes(SKETCH // 8) for s in names), np.uint64).reshape(len(names), -1)
            sets = _Sets(np.array([of[s][0] for s in names]), group, hub, np.array([of[s][3] for s in names]), sketch)
            out += fn(x, sets, pa.array(names, pa.binary()))
        return pa.Table.from_batches(out, schema=schema)

    where = lists.select("bucket", "sets").mapInArrow(own_sets, "bucket long, set_id binary").join(known, "set_id")
    return lists.groupBy("bucket").cogroup(where.groupBy("bucket")).applyInArrow(apply, sql)


def leader_votes(lists: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(follower, leader, hub, votes): in each list, a set votes for the set before it by size and position,
    and for the list's hub, the set that is in most lists (so it has least of its own), if they fit."""
    schema = pa.schema([("follower", pa.binary()), ("leader", pa.binary()), ("hub", pa.bool_()), ("votes", pa.int64())])

    def vote(x: _Lists, sets: _Sets, names: pa.Array) -> list[pa.RecordBatch]:
        width, here, out, degree = len(names), np.arange(len(x.list)), [], sets.degree
        order = np.lexsort((x.member, -degree[x.member], x.list))
        first = order[np.flatnonzero(np.diff(x.list[order], prepend=-1))]
        hubs = first[np.searchsorted(x.list[first], x.list)]
        for hub, lead in ((False, np.maximum(here - 1, 0)), (True, hubs)):
            fits = (x.list[lead] == x.list) & (lead != here) & _possible(x, degree, lead, here, percent)
            pairs, votes = np.unique(x.member[fits] * width + x.member[lead[fits]], return_counts=True)
            out.append(pa.RecordBatch.from_arrays([names.take(pa.array(pairs // width)), names.take(pa.array(pairs % width)),
                                                   pa.array([hub] * len(pairs), pa.bool_()), pa.array(votes, pa.int64())], schema=schema))
        return out

    return _with_sets(lists, known, vote, schema, "follower binary, leader binary, hub boolean, votes long")


def _crossing(x: _Lists, sets: _Sets, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of different groups (as member * width + member) and how many lists they share here.

    In each list the largest group is compared with the other sets, and these
    with each other; nothing within a group.  At a common n-gram with positions
    i and j, similar sets have min(i, j) common n-grams before it at most, and
    the rest after it: other blocks of positions are skipped.
    """
    width, span = len(x.sets), int(x.size.max()) + 1
    g = sets.group[x.member]
    kind = x.list * width + g
    kinds, inverse, count = np.unique(kind, return_inverse=True, return_counts=True)
    order = np.lexsort((count, kinds // width))
    last = np.flatnonzero(np.diff(kinds[order] // width, append=-1))
    major = np.zeros(int(x.list.max()) + 1, np.int64)
    major[kinds[order][last] // width] = kinds[order][last]
    is_major = kind == major[x.list]
    rest = np.flatnonzero(~is_major)
    if not len(rest):
        return
    most = np.flatnonzero(is_major)
    largest = 100 * x.size[rest] // percent
    at = x.list * span + x.size
    top = x.list[rest] * span + np.minimum(largest, span - 1)
    for others, low in ((most, np.searchsorted(at[most], x.list[rest] * span + (percent * x.size[rest] + 99) // 100)),
                        (rest, np.arange(1, len(rest) + 1))):
        high = np.maximum(np.searchsorted(at[others], top, "right"), low)
        done = np.concatenate([[0], np.cumsum(high - low)])
        row = 0
        while row < len(rest):
            end = max(row + 1, int(np.searchsorted(done, done[row] + FLUSH, "right")) - 1)
            n = (high - low)[row:end]
            left = np.repeat(rest[row:end], n)
            right = others[np.arange(done[row], done[end]) - np.repeat(done[row:end] - low[row:end], n)]
            row = end
            fits = _possible(x, sets.degree, left, right, percent) & (g[left] != g[right]) & _derivable(x, sets, left, right, percent)
            l, r = x.member[left[fits]], x.member[right[fits]]
            if len(l):
                yield np.unique(np.minimum(l, r) * width + np.maximum(l, r), return_counts=True)


def crossing_pairs(lists: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b, n_a, n_b) of sets in different components.

    Common n-grams of similar sets are all found, as far as the shorter of the
    two prefixes goes; what comes after it is at most the rest of that set.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("shared", pa.int64())])

    def cross(x: _Lists, sets: _Sets, names: pa.Array) -> list[pa.RecordBatch]:
        width, out = len(names), []
        size = np.zeros(width, np.int64)
        size[x.member] = x.size
        for pairs, shared in _crossing(x, sets, percent):
            a, b = pairs // width, pairs % width
            apart = np.bitwise_count(sets.sketch[a] ^ sets.sketch[b]).sum(axis=1, dtype=np.int64)
            close = size[a] + size[b] - apart >= 2 * _needed(size[a], size[b], percent)
            a, b, shared = a[close], b[close], shared[close]
            out.append(pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(size[a]), pa.array(size[b]),
                                                   pa.array(shared, pa.int64())], schema=schema))
        return out

    pairs = _with_sets(lists, known, cross, schema, "a binary, b binary, n_a long, n_b long, shared long")
    flip = F.col("a") > F.col("b")
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(flip, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
                           F.when(flip, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"), "shared")
    after = f"(({percent} * greatest(n_a, n_b) + 99) div 100 - 1)"
    return (ordered.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
            .where(f"shared + {after} >= (({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent})").drop("shared"))


def wanted_bits(lists: DataFrame) -> np.ndarray:
    """A bit map, of fixed size, of the hashes of all sets that share a list: whatever is not in it is not wanted."""
    kind = pa.schema([("part", pa.int32()), ("bits", pa.binary())])
    parts = 256

    def mark(batches):
        bits = np.zeros(BITMAP, bool)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                bits[np.frombuffer(blob, np.uint32)[::4] % BITMAP] = True
        for k, part in enumerate(np.packbits(bits).reshape(parts, -1)):
            if part.any():
                yield _table(kind, [(k, part.tobytes())])

    def merge(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(b, np.uint8) for b in table["bits"].to_pylist()]
        return pa.Table.from_batches([_table(kind, [(table["part"][0].as_py(), np.bitwise_or.reduce(rows).tobytes())])], schema=kind)

    out = np.zeros((parts, BITMAP // 8 // parts), np.uint8)
    merged = lists.select("sets").mapInArrow(mark, "part int, bits binary").groupBy("part").applyInArrow(merge, "part int, bits binary")
    for row in merged.collect():       # 256 rows of 4 KB
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return np.unpackbits(out.ravel()).astype(bool)


def set_texts(docs: DataFrame, size: int, bits: np.ndarray) -> DataFrame:
    """(set_id, text, sketch): one text, and the set's parity sketch, for every set that the bit map has."""
    schema = pa.schema([("set_id", pa.binary()), ("text", pa.string()), ("sketch", pa.binary())])
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def texts(batches):
        wanted = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            keep = []
            for digest, tokens, text in _distinct_sets([batch], size):
                if wanted[int.from_bytes(digest[:4], "little") % BITMAP]:
                    keep.append((digest, text.as_py(), _sketch(tokens)))
                if len(keep) >= 256:
                    yield _table(schema, keep)
                    keep = []
            yield _table(schema, keep)

    return docs.select("text").mapInArrow(texts, "set_id binary, text string, sketch binary").dropDuplicates(["set_id"])


def pair_overlaps(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(a, b, size_a, size_b, overlap) of each pair (a, b) of sets, counted on the whole sets."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("size_a", pa.int64()), ("size_b", pa.int64()), ("overlap", pa.int64())])

    def compare(batches):
        last, tokens = None, None
        for batch in batches:
            ids, others, firsts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            rows = []
            for row, other in shingle_sets(batch.column(3), size):
                if ids[row] != last:
                    last, tokens = ids[row], next(shingle_sets(firsts.slice(row, 1), size))[1]
                rows.append((last, others[row], len(tokens), len(other),
                             len(np.intersect1d(tokens, other, assume_unique=True))))
            yield _table(schema, rows)

    left = texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b"))
    return (pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
            .mapInArrow(compare, "a binary, b binary, size_a long, size_b long, overlap long"))


def similar_components(docs: DataFrame, size: int = 5, percent: int = 80, key: Column | None = None) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: doc_id, n_shingles, component_id.

    Sets link when 100 * intersection >= percent * union; component_id is the
    smallest doc_id reachable by links, the document itself included.  A text
    with fewer words than ``size`` is one n-gram; null texts and texts without
    words have the empty set and are linked with nothing.  Rows with a null
    doc_id take part and keep a null id; they give no component its name (their
    component_id is null if nothing else is linked).  Repeated rows are equal
    sets.  An empty table gives none.  Other columns are not read.  With a
    ``key`` of the rows, that is returned too, and ``component``, which names
    also components without any doc_id (null for the empty set).
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    spark = scratch.spark
    profiles = scratch.write(set_profiles(docs, size, key), "profiles")
    total = profiles.agg(F.sum("n")).first()[0] or 0
    bits = max(3, (total // BUCKET).bit_length())
    heavy, counts = frequent_tokens(docs, size, total, bits)
    broadcast = spark.sparkContext.broadcast
    postings = prefix_postings(docs, size, percent, bits, broadcast(heavy), broadcast(counts))
    lists = scratch.write(postings.groupBy("bucket").applyInArrow(_merge_lists, _LISTS_SQL), "lists")

    degrees = scratch.write(list_degrees(lists), "degrees")
    alone = degrees.withColumns({"component": F.col("set_id"), "hub": F.col("set_id"), "overlap": F.lit(-1).cast("long"),
                                 "sketch": F.lit(None).cast("binary")})
    votes = leader_votes(lists, alone, percent).groupBy("follower", "leader", "hub").agg(F.sum("votes").alias("votes"))
    led = scratch.write(votes.groupBy("follower", "hub").agg(F.max(F.struct("votes", "leader"))["leader"].alias("leader"))
                        .groupBy("follower", "leader").agg(F.bool_or("hub").alias("hub")), "led")
    texts = scratch.write(set_texts(docs, size, wanted_bits(lists)), "texts")

    linked = F.expr(f"100 * overlap >= {percent} * (size_a + size_b - overlap)")
    answers = scratch.write(pair_overlaps(led.select(F.col("leader").alias("a"), F.col("follower").alias("b")), texts, size)
                            .withColumn("linked", linked), "answers0")
    groups = connected_components(answers.where("linked").select("a", "b"), scratch, "first").withColumnRenamed("node", "set_id")
    hubs = (led.where("hub").select(F.col("leader").alias("a"), F.col("follower").alias("b")).join(answers, ["a", "b"])
            .select(F.col("b").alias("set_id"), F.col("a").alias("hub"), "overlap"))
    known = (degrees.join(texts.select("set_id", "sketch"), "set_id").join(groups, "set_id", "left").join(hubs, "set_id", "left")
             .select("set_id", "degree", "sketch", F.coalesce("component", "set_id").alias("component"),
                     F.coalesce("hub", "set_id").alias("hub"), F.coalesce("overlap", F.lit(-1)).alias("overlap")))
    crossing = scratch.write(crossing_pairs(lists, known, percent), "crossing")
    links = answers.where("linked").select("a", "b")
    if not crossing.isEmpty():
        links = links.unionByName(_compare_rest(crossing, answers, texts, scratch, size, percent))
    groups = connected_components(links, scratch, "all")
    scratch.drop("lists", "texts", "crossing", "led", "degrees")

    more = [] if key is None else ["key"]
    named = profiles.join(groups.select(F.col("node").alias("set_id"), "component"), "set_id", "left") \
        .select("doc_id", "n", F.coalesce("component", "set_id").alias("component"), *more)
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), *(["component"] + more if more else []))


def _compare_rest(crossing: DataFrame, answers: DataFrame, texts: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """Links (a, b) among the crossing pairs: pivots first, then those followers' pairs that the answers cannot rule out."""
    linked = answers.where("linked")
    followers = linked.select(F.col("b").alias("leader")).distinct()
    # The pivot of a set is its leader, if that follows nobody; else the set itself.
    pivots = scratch.write(
        linked.select(F.col("b").alias("set_id"), F.col("a").alias("leader"), "overlap", F.col("size_a").alias("pivot_size"))
        .join(followers, "leader", "left_anti").select("set_id", F.col("leader").alias("pivot"), "overlap", "pivot_size"), "pivots")
    pairs = crossing
    for end in ("a", "b"):
        own = pivots.select(F.col("set_id").alias(end), F.col("pivot").alias(f"p_{end}"), F.col("pivot_size").alias(f"pn_{end}"),
                            F.col("overlap").alias(f"o_{end}"))
        pairs = (pairs.join(own, end, "left")
                 .withColumns({f"p_{end}": F.coalesce(f"p_{end}", end), f"pn_{end}": F.coalesce(f"pn_{end}", f"n_{end}"),
                               f"rest_{end}": F.col(f"n_{end}") - F.coalesce(f"o_{end}", f"n_{end}")}).drop(f"o_{end}"))
    pairs = scratch.write(pairs.select("a", "b", "n_a", "n_b", "pn_a", "pn_b", (F.col("rest_a") + F.col("rest_b")).alias("rest"),
                                       F.least("p_a", "p_b").alias("low"), F.greatest("p_a", "p_b").alias("high")), "pairs")
    is_pivot = (F.col("low") == F.least("a", "b")) & (F.col("high") == F.greatest("a", "b"))
    link = F.expr(f"100 * overlap >= {percent} * (size_a + size_b - overlap)")
    first = scratch.write(pair_overlaps(pairs.where(is_pivot), texts, size).withColumn("linked", link), "answers1")
    needed = lambda x, y: F.ceil((F.lit(percent) * (F.col(x) + F.col(y))) / F.lit(100 + percent))
    computed = first.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), "overlap")
    # Pivots that are no candidates have less than the overlap they need.
    bound = F.coalesce(F.col("overlap"), needed("pn_a", "pn_b") - 1) + F.col("rest")
    open_pairs = (pairs.where(~is_pivot).join(computed, ["low", "high"], "left")
                  .where(bound >= needed("n_a", "n_b")).select("a", "b"))
    second = scratch.write(pair_overlaps(open_pairs, texts, size).withColumn("linked", link), "answers2")
    return first.where("linked").select("a", "b").unionByName(second.where("linked").select("a", "b"))
