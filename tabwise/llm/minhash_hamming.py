"""MinHash near-duplicates by a multi-index Hamming join.

A document is its set of distinct word n-grams; equal sets are one set.  A set's
signature has ``slots`` minima, of which ``bits`` bits each are kept.  Two sets
of similarity s differ in about ``slots * (1 - s)`` slots.  All pairs that differ
in at most ``chunks * (errors + 1) - 1`` slots are found: by the pigeonhole
principle, one of the ``chunks`` parts of such a pair's signatures has at most
``errors`` different slots, so both sets share a key, made of a part without
``errors`` of its slots, for each way to leave them out.  With 64 slots, 12
chunks and 1 error that is 23 slots; a pair of similarity 0.85 goes beyond it
once in 120,000 times, one of 0.9 once in 200 million.

Pairs are confirmed on the full sets.  No key's sets are ever paired with each other
as a whole: first every set is compared with one leader, the set of its keys
that shares most keys with others.  Then only keys that still hold several
components are joined, the sets outside the leader's component with all, in a
grid of salted parts, under the condition that their signatures and their parity sketches
(a lower bound of the difference of two sets) are close enough.  In the first rounds
each set outside is compared with the closest of these partners alone, which joins most of
a large group of near copies; the last round compares all pairs that are still
in different components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabwise.llm.components import connected_components
from tabwise.llm.scratch import Scratch
from tabwise.llm.textarrays import mix, shingle_sets

SLOTS, BITS, CHUNKS, ERRORS = 64, 8, 12, 1
#: 64-bit words of a set's parity sketch.
SKETCH = 8
#: Tokens that are hashed at once.
STEP = 2048
#: A key's sets, or a leader's followers, that one task gets together, at most about.
PART = 4096
#: Pairs whose signatures a task compares at once.
PAIRS = 1 << 16
#: Rounds in which each set outside its key's leading component is compared with its closest partner only.
ROUNDS = 2
#: A list of texts to fetch of up to so many rows (24 bytes each) is broadcast.
BROADCAST_ROWS = 1 << 20


def _hashers(slots: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7 * slots + 1))
    return rng.integers(0, 1 << 63, slots, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, slots, dtype=np.uint64)


def signature(tokens: np.ndarray, multiply: np.ndarray, salt: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` bits of every slot's minimum, packed into 64-bit words."""
    least = np.full(len(salt), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(tokens), STEP):
        value = (tokens[at:at + STEP, None] ^ salt) * multiply
        value ^= value >> np.uint64(29)
        np.minimum(least, value.min(axis=0), out=least)
    per = 64 // bits
    low = (mix(least) & np.uint64((1 << bits) - 1)).reshape(-1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(bits)), axis=1)


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """For each of 64 * SKETCH places, whether an odd number of the set's n-grams fall there."""
    odd = (np.bincount((tokens % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def _names(slots: int, bits: int) -> tuple[list[str], list[str]]:
    return [f"s{k}" for k in range(slots * bits // 64)], [f"k{k}" for k in range(SKETCH)]


def set_signatures(docs: DataFrame, size: int, slots: int, bits: int, key: Column | None = None) -> DataFrame:
    """(doc_id, t1, t2[, key], n, set_id, s0.., k0..): each text's name, set size, set digest, signature and sketch (null if empty)."""
    multiply, salt = _hashers(slots)
    words = [w for part in _names(slots, bits) for w in part]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(1), "text").alias("t1"), F.xxhash64(F.lit(2), "text").alias("t2"),
                       *([] if key is None else [key.alias("key")]), "text")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n", T.LongType()), T.StructField("set_id", T.BinaryType()),
                           *[T.StructField(w, T.LongType()) for w in words]])

    def sign(batches):
        for batch in batches:
            n, ids, signs = [], [], np.zeros((batch.num_rows, len(words)), np.uint64)
            for row, tokens in shingle_sets(batch.column(batch.num_columns - 1), size):
                n.append(len(tokens))
                ids.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
                if len(tokens):
                    signs[row] = np.concatenate([signature(tokens, multiply, salt, bits), parity_sketch(tokens)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(ids, pa.binary()), *(pa.array(c.view(np.int64)) for c in signs.T.copy())],
                names=[*batch.schema.names[:-1], "n", "set_id", *words])

    return rows.mapInArrow(sign, schema)


def chunk_keys(sets: DataFrame, slots: int, bits: int, chunks: int, errors: int) -> DataFrame:
    """(key, sid): of each chunk of the signature, its slots without ``errors`` of them, in every way."""
    names = _names(slots, bits)[0]
    per = 64 // bits
    groups = [[int(s) for s in part] for part in np.array_split(np.arange(slots), chunks)]
    kept = [(c, left) for c, part in enumerate(groups) for left in combinations(part, max(1, len(part) - errors))]
    kind = pa.schema([("key", pa.int64()), ("sid", pa.int64())])

    def keys(batches):
        for batch in batches:
            words = np.column_stack([batch.column(1 + k).to_numpy() for k in range(len(names))]).view(np.uint64)
            slot = (words[:, :, None] >> (np.arange(per, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
            slot, sid = slot.reshape(len(words), -1), batch.column(0)
            for salt, (_, left) in enumerate(kept):
                acc = np.full(len(words), np.uint64(salt + 1))
                for s in left:
                    acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + slot[:, s])
                yield pa.RecordBatch.from_arrays([pa.array(acc.view(np.int64)), sid], schema=kind)

    return sets.select("sid", *names).mapInArrow(keys, "key long, sid long")


class Nearness(NamedTuple):
    """Whether sets can be links: signatures within ``distance`` fields, sketches that leave ``percent`` similarity possible."""

    bits: int
    words: int        #: 64-bit words of a signature; those of the sketch follow
    distance: int
    percent: int

    def __call__(self, one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray) -> np.ndarray:
        """Mask over rows of ``one`` and ``other`` (pairs x words) with set sizes ``n_one``, ``n_other``."""
        n = n_one + n_other
        apart = np.bitwise_count(one[:, self.words:] ^ other[:, self.words:]).sum(axis=1, dtype=np.int64)
        near = n - apart >= 2 * -(-self.percent * n // (100 + self.percent))
        fields, shift = one[near, :self.words] ^ other[near, :self.words], self.bits // 2
        while shift:
            fields |= fields >> np.uint64(shift)
            shift //= 2
        mask = np.uint64(sum(1 << k for k in range(0, 64, self.bits)))
        near[near] = np.bitwise_count(fields & mask).sum(axis=1, dtype=np.int64) <= self.distance
        return near


def _words(batch: pa.RecordBatch, first: int, count: int) -> np.ndarray:
    return np.column_stack([batch.column(first + k).to_numpy() for k in range(count)]).view(np.uint64)


def exact_overlaps(pairs: DataFrame, docs: DataFrame, sets: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """(a, b, size_a, size_b, overlap) of pairs of sets, counted on the full sets.

    Each needed text is fetched once and goes once to every pair of which it is
    ``b``; the ``a`` of many pairs goes once to each part of PART pairs.  A part
    streams through its task in order, ``a`` first.
    """
    spark = scratch.spark
    pairs = scratch.write(pairs.select("a", "b"), "pairs")
    rows = sets.select("sid", "t1", "t2", F.coalesce("least", F.lit(-1 << 63)).alias("least"))
    need = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(rows, "sid"), "need")
    need = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    schema = pa.schema([("sid", pa.int64()), ("text", pa.string())])

    def once(batches):
        seen = set()      # repeated rows, of which each task passes on one
        for batch in batches:
            keep = [k for k, s in enumerate(batch.column(0).to_pylist()) if not (s in seen or seen.add(s))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string())], schema=schema).take(pa.array(keep, pa.int64()))

    texts = docs.select(F.xxhash64(F.lit(1), "text").alias("t1"), F.xxhash64(F.lit(2), "text").alias("t2"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)).alias("least"), "text").join(need, ["t1", "t2", "least"])
    texts = scratch.write(texts.select("sid", "text").mapInArrow(once, "sid long, text string"), "texts")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    left = parts.select(F.col("a").alias("sid"), F.col("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"))
    right = pairs.join(parts, "a").select(F.col("b").alias("sid"), "a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.lit(1).alias("side"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("size_a", pa.int64()), ("size_b", pa.int64()), ("overlap", pa.int64())])

    def compare(batches) -> Iterator[pa.RecordBatch]:
        last, tokens = None, None
        for batch in batches:
            rows, (a, part, side, sid) = [], (batch.column(k).to_pylist() for k in range(4))
            for row, other in shingle_sets(batch.column(4), size):
                if side[row] == 0:
                    last, tokens, before = (a[row], part[row]), other, None
                elif sid[row] != before:
                    before = sid[row]
                    rows.append((last[0], before, len(tokens), len(other), len(np.intersect1d(tokens, other, assume_unique=True))))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, out)], schema=out)

    dealt = left.unionByName(right).join(texts, "sid").repartition("a", "part").sortWithinPartitions("a", "part", "side", "sid")
    return dealt.select("a", "part", "side", "sid", "text").mapInArrow(compare, "a long, b long, size_a long, size_b long, overlap long")


def _led(postings: DataFrame) -> DataFrame:
    """(a, b): every set b with one leader a, of the leaders of its keys the one of most keys.

    A key's leader is its set of the largest sum of key sizes, the set that most others are near to.
    """
    weight = postings.groupBy("sid").agg(F.sum("n").alias("weight"))
    leaders = postings.join(weight, "sid").groupBy("key").agg(F.max(F.struct("weight", "sid")).alias("lead"))
    votes = (postings.join(leaders, "key").where(F.col("lead.sid") != F.col("sid"))
             .groupBy("sid", F.col("lead.sid").alias("a"), F.col("lead.weight").alias("weight")).agg(F.count(F.lit(1)).alias("votes")))
    return votes.groupBy(F.col("sid").alias("b")).agg(F.max(F.struct("votes", "weight", "a"))["a"].alias("a")).select("a", "b")


def _near_pairs(pairs: DataFrame, known: DataFrame, near: Nearness) -> DataFrame:
    """The pairs (a, b) whose signatures and sketches in ``known (sid, n, words)`` pass ``near``."""
    count = len(known.columns) - 2
    for end in ("a", "b"):
        pairs = pairs.join(known.select(F.col("sid").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in known.columns[1:]]), end)

    def test(batches):
        for batch in batches:
            one, other = _words(batch, 3, count), _words(batch, 4 + count, count)
            keep = near(one, other, batch.column(2).to_numpy(), batch.column(3 + count).to_numpy())
            yield batch.select([0, 1]).filter(pa.array(keep))

    words = [f"{end}_{c}" for end in ("a", "b") for c in known.columns[1:]]
    return pairs.select("a", "b", *words).mapInArrow(test, "a long, b long")


def _crossing(postings: DataFrame, groups: DataFrame, known: DataFrame, scratch: Scratch, near: Nearness, nearest: bool = False) -> DataFrame:
    """(a, b): sets of different components that share a key and pass ``near``.

    A key's sets outside its leading component (side 0) meet all of its sets
    (side 1) in a grid of salted parts of about PART sets each.  Parts stream
    through the tasks in order.  With ``nearest``, only the closest of these
    partners of each set outside (by sketch, then name): one row a set, and none
    at all only if there are no such pairs.
    """
    rows = postings.join(groups, "sid", "left").select("key", "sid", F.coalesce("component", "sid").alias("component"))
    keys = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"),
                                   F.max(F.struct(F.col("component") != F.col("sid"), "component"))["component"].alias("major"))
    keys = keys.where("low <> high").select("key", "major", F.ceil(F.col("n") / PART).alias("parts"))
    placed = scratch.write(rows.join(keys, "key").select("key", "sid", "component", (F.col("component") != F.col("major")).alias("minor"), "parts"), "open")
    part = F.pmod(F.xxhash64("sid"), "parts")
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    minor = placed.where("minor").select("key", part.alias("one"), spread.alias("two"), F.lit(0).alias("side"), "sid", "component", "minor")
    every = placed.select("key", spread.alias("one"), part.alias("two"), F.lit(1).alias("side"), "sid", "component", "minor")
    count = len(known.columns) - 2
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), *([("apart", pa.int64())] if nearest else [])])

    def meet(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(group).combine_chunks().to_batches()[0]
        words, n, split = _words(table, 8, count), table.column(7).to_numpy(), int(np.searchsorted(table.column(3).to_numpy(), 1))
        sid, component = table.column(4).to_numpy(), table.column(5).to_numpy()
        outside = table.column(6).to_numpy(zero_copy_only=False)
        step = max(1, PAIRS // max(1, len(sid) - split))
        for at in range(0, split, step):
            left = np.arange(at, min(at + step, split))
            fits = component[left, None] != component[split:]
            if not nearest:
                fits &= ~outside[split:] | (sid[left, None] < sid[split:])
            i, j = np.nonzero(fits)
            i, j = left[i], split + j
            keep = near(words[i], words[j], n[i], n[j])
            if nearest:
                i, j = i[keep], j[keep]
                apart = np.bitwise_count(words[i, near.words:] ^ words[j, near.words:]).sum(axis=1, dtype=np.int64)
                order = np.lexsort((sid[j], apart, i))
                best = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
                yield pa.RecordBatch.from_arrays([pa.array(sid[i[best]]), pa.array(sid[j[best]]), pa.array(apart[best])], schema=kind)
                continue
            one, other = sid[i[keep]], sid[j[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other))], schema=kind)

    def stream(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            place = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(place)]
            if held and len(place) and tuple(place[0]) != last:
                yield from meet(held)
                held = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a:
                    yield from meet(held)
                    held = []
                held.append(batch.slice(a, b - a))
            if len(place):
                last = tuple(place[-1])
        if held:
            yield from meet(held)

    dealt = minor.unionByName(every).join(known, "sid").select("key", "one", "two", "side", "sid", "component", "minor", *known.columns[1:])
    dealt = dealt.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "side")
    if not nearest:
        return dealt.mapInArrow(stream, "a long, b long").distinct()
    closest = dealt.mapInArrow(stream, "a long, b long, apart long").groupBy("a").agg(F.min(F.struct("apart", "b"))["b"].alias("b"))
    return closest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85, slots: int = SLOTS, bits: int = BITS, chunks: int = CHUNKS,
                    errors: int = ERRORS, key: Column | None = None) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: doc_id, n_shingles, component_id, kept[, key].

    Sets link when 100 * intersection >= percent * union and their signatures
    differ in fewer than ``chunks * (errors + 1)`` slots; component_id is the
    smallest doc_id reachable by links, the document itself included, and kept
    says whether that is its own.  A text with fewer words than ``size`` is one
    n-gram; null texts and texts without words have the empty set and are linked
    with nothing.  Rows with a null doc_id take part and keep a null id; they
    name no component (component_id is null if nothing else is linked, then
    they are kept).  Repeated rows are equal sets.  An empty table gives none.
    Other columns are not read.
    """
    if (slots * bits) % 64 or 64 % bits:
        raise ValueError("slots * bits must be whole 64-bit words, and bits a divisor of 64")
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.write(set_signatures(docs, size, slots, bits, key), "signatures")
    signs, sketch = _names(slots, bits)
    name = F.min(F.struct("t1", "t2", "doc_id"))
    sets = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(name.alias("_name"), *[F.min(c).alias(c) for c in ["n", *signs, *sketch]])
    sets = scratch.write(sets.select(F.monotonically_increasing_id().alias("sid"), "set_id", "_name.t1", "_name.t2", F.col("_name.doc_id").alias("least"),
                                     "n", *signs, *sketch), "sets")
    keys = chunk_keys(sets, slots, bits, chunks, errors)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    postings = scratch.write(keys.join(shared, "key"), "postings")

    near = Nearness(bits, len(signs), chunks * (errors + 1) - 1, percent)
    known = sets.select("sid", "n", *signs, *sketch)
    led = _near_pairs(_led(postings), known, near)
    linked = f"100 * overlap >= {percent} * (size_a + size_b - overlap)"
    links = scratch.write(exact_overlaps(led, docs, sets, Scratch(scratch.spark, "minhash-led"), size).where(linked).select("a", "b"), "led")
    groups = connected_components(links, scratch, "first").withColumnRenamed("node", "sid")
    for step in range(ROUNDS + 1):
        last = step == ROUNDS       # then every pair that is left
        crossing = scratch.write(_crossing(postings, groups, known, scratch, near, not last), f"crossing{step}")
        scratch.drop("open")
        if crossing.isEmpty():
            break
        rest = exact_overlaps(crossing, docs, sets, Scratch(scratch.spark, f"minhash-rest{step}"), size).where(linked).select("a", "b")
        links = scratch.write(links.unionByName(rest), f"links{step}")
        groups = connected_components(links, scratch, f"all{step}").withColumnRenamed("node", "sid")
    scratch.drop("postings", *[f"crossing{step}" for step in range(ROUNDS + 1)])

    of_set = sets.select("set_id", "sid").join(groups, "sid", "left").select("set_id", F.coalesce("component", "sid").alias("component"))
    named = rows.select("doc_id", "n", "set_id", *([] if key is None else ["key"])).join(of_set, "set_id", "left")
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    least_id = F.coalesce("least", "doc_id")
    return named.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), least_id.alias("component_id"),
                                                         F.col("doc_id").eqNullSafe(least_id).alias("kept"), *([] if key is None else ["key"]))
