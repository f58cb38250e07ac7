"""Prefix trie of conversations, rolled up in depth bands.

A node is a distinct sequence of first turns.  Its name is 128 bits: the xor of
position-salted turn hashes, so prefixes are running xors (of fixed-length
segments, then of the segments before), and a parent's name follows from its
child's.  No conversation, path or node is ever gathered in one group.

Subtree totals are a depth-band rollup.  Depths are cut into bands of ``BAND``.
Every node adds to its band's root, the band roots form a trie that is ``BAND``
times shallower and is rolled up in the same way, then the completed totals of
the roots below are carried to their parents, and each node explodes to its
ancestors inside its band only.  Rounds grow with the logarithm of the depth, rows with
at most ``BAND`` a node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwise.llm.scratch import Scratch

BAND = 8
#: Turns whose running xor is computed together.
SEGMENT = 1024


def _zero() -> Column:
    return F.lit(0).cast("long")


def ordered_turns(conversations: DataFrame, scratch: Scratch, *keep: str) -> DataFrame:
    """(conv_id, rank, t1, t2, size[, role, text]): every turn's place in its conversation, from 1.

    Order: turn (null first), then role, then text; null role and text are
    empty.  Rows are range-partitioned and sorted once, so a conversation of any
    length spans as many tasks as it needs; a rank is the place in the
    partition plus the conversation's rows in partitions before.
    """
    spark = scratch.spark
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"),
                      F.xxhash64(F.lit(1), "role", "text").alias("t1"), F.xxhash64(F.lit(2), "role", "text").alias("t2"),
                      F.length("text").cast("long").alias("size"), *keep))
    placed = scratch.write(placed, "placed" + "-".join(["", *keep]))
    runs = placed.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    runs = runs.select("conv_id", "part", (F.col("first") - before).alias("_zero"))
    return placed.join(runs, ["conv_id", "part"]).select(
        "conv_id", (F.col("place") - F.col("_zero") + 1).alias("rank"), "t1", "t2", "size", *keep)


def spliced(turns: DataFrame, convs: DataFrame, base: Column, head: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the head of another one: (conv_id, pos, ... of turns) and (conv_id, length).

    ``convs (conv_id, n)``; ``base`` and ``head`` are expressions on conv_id: the
    first ``head`` (at most ``longest``) turns of conversation ``base`` (all if
    fewer, none if absent), then the own turns after the first ``head``.
    """
    plan = convs.select("conv_id", "n", base.alias("base"), head.alias("head"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("_have"))
    plan = plan.join(sizes, "base", "left").withColumn("taken", F.least("head", F.coalesce("_have", F.lit(0)))).drop("_have")
    rest = [c for c in turns.columns if c not in ("conv_id", "rank")]
    heads = (turns.where(F.col("rank") <= longest).withColumnRenamed("conv_id", "base").join(plan, "base").where("rank <= taken")
             .select("conv_id", F.col("rank").alias("pos"), *rest))
    tails = (turns.join(plan.select("conv_id", "head", "taken"), "conv_id").where("rank > head")
             .select("conv_id", (F.col("rank") - F.col("head") + F.col("taken")).alias("pos"), *rest))
    return heads.unionByName(tails), plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length"))


def prefix_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, size): name of every prefix of ``turns (conv_id, pos, t1, t2, size)`` and of its parent."""
    salted = turns.select("conv_id", "pos", "size", F.xxhash64("pos", "t1").alias("x1"), F.xxhash64("pos", "t2").alias("x2"),
                          F.floor((F.col("pos") - 1) / SEGMENT).alias("_segment"))
    running = Window.partitionBy("conv_id", "_segment").orderBy("pos")
    inside = salted.withColumns({f"p{k}": F.expr(f"bit_xor(x{k})").over(running) for k in (1, 2)})
    whole = salted.groupBy("conv_id", "_segment").agg(*[F.expr(f"bit_xor(x{k})").alias(f"s{k}") for k in (1, 2)])
    earlier = Window.partitionBy("conv_id").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("conv_id", "_segment", *[F.coalesce(F.expr(f"bit_xor(s{k})").over(earlier), _zero()).alias(f"b{k}") for k in (1, 2)])
    named = inside.join(before, ["conv_id", "_segment"]).select(
        "conv_id", F.col("pos").cast("long").alias("depth"), "size", "x1", "x2", *[F.col(f"p{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"p{k}") for k in (1, 2)])
    return named.select("conv_id", "depth", "p1", "p2", *[F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"q{k}") for k in (1, 2)], "size")


def band_rollup(nodes: DataFrame, paths: DataFrame, sums: list[str], scratch: Scratch, band: int = BAND, level: int = 0) -> DataFrame:
    """(p1, p2, sums): totals over every node's subtree, itself included.

    ``nodes (p1, p2, conv_id, depth, sums)`` with conv_id any member;
    ``paths (conv_id, depth, p1, p2)`` holds all prefixes of these members, the root at depth 0 included.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    total = [F.sum(c).alias(c) for c in sums]
    here = F.floor(F.col("depth") / band).alias("_band")
    if deepest >= band:
        # Band roots and their totals inside the band: no explosion, one row a node.
        tops = paths.where(F.col("depth") % band == 0).select("conv_id", F.floor(F.col("depth") / band).alias("depth"), "p1", "p2")
        tops = scratch.write(tops, f"tops{level}")
        own = nodes.select("conv_id", here, *sums).join(tops.withColumnRenamed("depth", "_band"), ["conv_id", "_band"])
        inside = own.groupBy("p1", "p2").agg(*total)
        roots = nodes.where(F.col("depth") % band == 0).select("p1", "p2", "conv_id", F.floor(F.col("depth") / band).alias("depth"))
        roots = scratch.write(roots.join(inside, ["p1", "p2"]), f"roots{level}")
        done = band_rollup(roots, tops, sums, scratch, band, level + 1)
        # Each completed root (but the trie's own) adds to its parent, the node above it on its path.
        below = done.join(roots.where("depth > 0").select("p1", "p2", "conv_id", (F.col("depth") * band - 1).alias("depth")), ["p1", "p2"])
        parents = paths.where(F.col("depth") % band == band - 1)
        carried = below.drop("p1", "p2").join(parents, ["conv_id", "depth"]).groupBy("p1", "p2").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
        nodes = nodes.join(carried, ["p1", "p2"], "left").select(
            "p1", "p2", "conv_id", "depth", *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in sums])
    chains = paths.groupBy("conv_id", here).agg(F.collect_list(F.struct("depth", "p1", "p2")).alias("_chain"))     # at most `band` a row
    up = nodes.select("conv_id", "depth", here, *sums).join(chains, ["conv_id", "_band"])
    out = up.select(F.explode(F.filter("_chain", lambda x: x["depth"] <= F.col("depth"))).alias("_at"), *sums)
    return scratch.write(out.groupBy(F.col("_at.p1").alias("p1"), F.col("_at.p2").alias("p2")).agg(*total), f"totals{level}")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) of ``ends (p1, p2, conv_id)``: rows stream through the hash in order, no list is built."""
    kind = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])

    def digest(batches):
        node, state = None, None
        for batch in batches:
            rows = []
            for p1, p2, conv in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (p1, p2) != node:
                    if node is not None:
                        rows.append((*node, state.hexdigest()))
                    node, state = (p1, p2), hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [()] * 3, kind)], schema=kind)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, state.hexdigest()), kind)], schema=kind)

    return (ends.select("p1", "p2", "conv_id").repartition("p1", "p2").sortWithinPartitions("p1", "p2", "conv_id")
            .mapInArrow(digest, "p1 long, p2 long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, lengths: DataFrame, scratch: Scratch, band: int = BAND) -> DataFrame:
    """One row per node of ``turns (conv_id, pos, t1, t2, size)``; ``lengths (conv_id, length)`` has all members.

    p1, p2 (its name), conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    lengths = scratch.write(lengths, "lengths")
    paths = scratch.write(prefix_paths(turns), "paths")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("conv_id IS NOT NULL").select(
        _zero().alias("p1"), _zero().alias("p2"), "conv_id", _zero().alias("depth"), "n_convs", F.lit(None).cast("long").alias("q1"),
        F.lit(None).cast("long").alias("q2"), _zero().alias("size"))
    least = [F.min(c).alias(c) for c in ("conv_id", "depth", "q1", "q2", "size")]
    nodes = paths.groupBy("p1", "p2").agg(*least, F.count(F.lit(1)).alias("n_convs"))
    nodes = scratch.write(nodes.unionByName(root), "nodes")
    children = nodes.where("q1 IS NOT NULL").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    valued = scratch.write(nodes.join(children, ["p1", "p2"], "left").select(
        "p1", "p2", "conv_id", "depth", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")), "valued")
    members = nodes.select("conv_id").distinct()
    chains = paths.select("conv_id", "depth", "p1", "p2").unionByName(
        lengths.select("conv_id", _zero().alias("depth"), _zero().alias("p1"), _zero().alias("p2"))).join(members, "conv_id", "left_semi")
    totals = band_rollup(valued.select("p1", "p2", "conv_id", "depth", "n_leaves", "saved_tokens"),
                         scratch.write(chains, "chains"), ["n_leaves", "saved_tokens"], scratch, band)
    ends = (paths.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("p1", "p2", "conv_id")
            .unionByName(lengths.where("length = 0").select(_zero().alias("p1"), _zero().alias("p2"), "conv_id")))
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(parents, ["q1", "q2"], "left").join(valued.select("p1", "p2", "n_children"), ["p1", "p2"]).join(totals, ["p1", "p2"])
            .join(_end_digests(ends), ["p1", "p2"], "left")
            .select("p1", "p2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame, band: int = BAND, span: int = 100, heads: int = 6) -> DataFrame:
    """Trie of ``conversations (conv_id, turn, role, text)`` rebuilt with a shared head.

    Conversation c is the first h turns of conversation c - c % ``span``, then
    its own after the first h; h = crc32(decimal c) % ``heads``.  Equal turns and
    repeated rows are ordered by role, then text; each repeated row is a turn.
    Rows without conv_id belong to no conversation and are left out.  Long texts
    count as any other.  An empty table has no node, not even a root.  Other
    columns are not read.  See ``prefix_trie`` for the columns.
    """
    scratch = Scratch(conversations.sparkSession, "prefix-trie")
    turns = scratch.write(ordered_turns(conversations, scratch), "turns")
    convs = scratch.write(turns.groupBy("conv_id").agg(F.max("rank").alias("n")), "convs")
    base = F.col("conv_id") - F.col("conv_id") % span
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("long")
    rebuilt, lengths = spliced(turns, convs, base, head, heads - 1)
    return prefix_trie(rebuilt, lengths, scratch, band)


def node_texts(trie: DataFrame, conversations: DataFrame, span: int = 100, heads: int = 6) -> DataFrame:
    """``trie`` with each node's last turn (role, text; both null at the root)."""
    scratch = Scratch(conversations.sparkSession, "prefix-trie-texts")
    turns = scratch.write(ordered_turns(conversations, scratch, "role", "text"), "turns")
    base = F.col("conv_id") - F.col("conv_id") % span
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("long")
    rebuilt, _ = spliced(turns, turns.groupBy("conv_id").agg(F.max("rank").alias("n")), base, head, heads - 1)
    last = rebuilt.select("conv_id", F.col("pos").cast("long").alias("depth"), "role", "text")
    return trie.join(last, ["conv_id", "depth"], "left")
