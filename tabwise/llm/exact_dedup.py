"""Exact deduplication with disk-backed streaming state.

Method: a digest stream (digest, stable identifier, content locator) feeds a
streaming aggregation whose state lives in RocksDB without watermark, so keys
never expire.  The state keeps one row per digest: the number of rows, and the
identifier and locator of the row that stays.  The finished state is read back
through Spark's state data source.  Digests with more than one row (hits) then
have their full normalised bytes compared: smallest and largest text of the
digest must be equal; where they are not, rows of that digest are grouped by
their bytes.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabwise.llm.scratch import Scratch
from tabwise.session import session_conf

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Hash slots of the hit pre-filter: an upper bound for the rows that it broadcasts.
HIT_SLOTS = 1 << 18


def normalised(text: Column) -> Column:
    """The text without space, tab, LF, VT, FF and CR; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digest_state(digests: DataFrame, scratch: Scratch) -> DataFrame:
    """Run a stream of (digest, doc_id, n_points, locator) to its end; its state as a table.

    Returns digest, group_size and keep (n_points, inverted doc_id, locator).
    The state rows are (digest) -> (count, best row so far).
    """
    spark = scratch.spark
    best = F.struct("n_points", F.bitwise_not("doc_id").alias("inverted"), "locator")
    counted = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(best).alias("keep"))
    # Many small stores: no disk set aside beforehand for their logs.
    with session_conf(spark, "spark.sql.streaming.stateStore.providerClass", _ROCKSDB), \
            session_conf(spark, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false"), \
            session_conf(spark, "spark.sql.streaming.stateStore.unloadOnCommit", "true"):
        query = (counted.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
                 .option("checkpointLocation", scratch.path("state")).start())
        query.awaitTermination()
        state = spark.read.format("statestore").load(scratch.path("state"))
    count, kept = state.schema["value"].dataType.fieldNames()
    return scratch.write(state.select(F.col("key.digest").alias("digest"), F.col(f"value.`{count}`").alias("group_size"),
                                      F.col(f"value.`{kept}`").alias("keep")), "groups")


def exact_dedup(docs: DataFrame, digest=sha256, key: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, locator.

    Two texts are equal when the same after deleting white space; null equals
    the empty text.  The longest original text (in code points) stays, then the
    smallest doc_id (a null doc_id last), then the first place in the table:
    of repeated rows exactly one has ``kept``.  An empty table gives no rows;
    columns other than doc_id and text are not read, so their names cannot
    clash.  ``digest`` is the grouping hash; any function gives whole results,
    as hits are compared byte by byte.  With a ``key`` of the rows, that is
    returned too.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    spark = scratch.spark
    norm = normalised(F.col("text"))
    thin = scratch.write(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
        digest(norm).alias("digest"), *([] if key is None else [key.alias("key")])), "digests")
    locator = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    placed = thin.withColumn("locator", locator)
    stream = spark.readStream.schema(thin.schema).parquet(scratch.path("digests")).withColumn("locator", locator)
    groups = digest_state(stream, scratch)

    # Full bytes on hits.  A broadcast of at most HIT_SLOTS slot numbers drops most rows without a hit;
    # what is left is reduced to two texts a digest before the shuffle.
    slot = F.pmod(F.xxhash64("digest"), F.lit(HIT_SLOTS)).cast("int")
    slots = groups.where("group_size > 1").select(slot.alias("_slot")).distinct()
    texts = docs.select(norm.alias("norm")).withColumn("digest", digest(F.col("norm"))).withColumn("_slot", slot)
    suspects = texts.join(F.broadcast(slots), "_slot", "left_semi")
    clash = (suspects.groupBy("digest").agg(F.min("norm").alias("_low"), F.max("norm").alias("_high"))
             .where("_low <> _high").select("digest"))
    clash = scratch.write(clash, "clashes")
    rows = placed.join(groups, "digest")
    if not clash.isEmpty():
        rows = _split_clashes(docs, rows, clash, digest)
    scratch.drop("state")
    return rows.select(
        "doc_id", F.bitwise_not("keep.inverted").alias("keep_id"), "group_size",
        (F.col("locator") == F.col("keep.locator")).alias("kept"), F.col("digest").alias("text_sha256"), "locator", *([] if key is None else ["key"]))


def _split_clashes(docs: DataFrame, rows: DataFrame, clash: DataFrame, digest) -> DataFrame:
    """Group the rows of clashing digests by their bytes; rows of ``docs`` are found again by id, length and digest."""
    key = [c for c in rows.columns if c == "key"]
    norm = normalised(F.col("text"))
    points = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), points.alias("n_points"), norm.alias("norm"))
             .withColumn("digest", digest(F.col("norm"))).join(clash, "digest", "left_semi").distinct())
    same = [F.col("r.digest") == F.col("t.digest"), F.col("r.n_points") == F.col("t.n_points"),
            F.col("r.doc_id").eqNullSafe(F.col("t.doc_id"))]
    apart = (rows.alias("r").join(texts.alias("t"), same)
             .select("r.digest", "r.doc_id", "r.n_points", "r.locator", "t.norm", *[f"r.{c}" for c in key]))
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("inverted"), "locator")).alias("keep")
    sizes = apart.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("group_size"), best)
    apart = apart.join(sizes, ["digest", "norm"]).select("digest", "doc_id", "n_points", "locator", "group_size", "keep", *key)
    return rows.join(clash, "digest", "left_anti").select(apart.columns).unionByName(apart)
