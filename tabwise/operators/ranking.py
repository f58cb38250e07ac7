"""Exact, deterministic ranks in a pseudo-random (hash) order — without global windows.

Splits and folds need every row's exact position in a seeded shuffle order,
per stratum.  ``row_number().over(Window.partitionBy(label).orderBy(h))``
would put a whole class (possibly a third of 100 TB) into one task, and an
unpartitioned window puts everything into one task.

Here the order key is ``h = md5("<seed>:<id>")`` (identical in any SQL engine),
and buckets are prefixes of ``h``, so bucket order agrees with ``h`` order.
Because md5 is uniform, a hot stratum spreads over many balanced buckets.

``rank_segments`` finds the order keys of the rows at the wanted cuts (bucket
counts, then a sort of the few buckets that hold a cut) and compares every row
with them: the table itself is not shuffled.  A cut is a key and how many rows
of that key come before it.  Where a cut key has several rows, only these are
ranked, by all their columns and then their place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, MapType, StructField, StructType, VariantType

from tabwise.functions.columns import quoted
from tabwise.session import materialize

ROWS_PER_BUCKET = 1 << 16


def hash_key(id_cols: list[str], seed: int) -> Column:
    """md5 hex of "<seed>:<id>[:<id2>...]" — reproducible in DuckDB/Postgres as md5(...)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]))


def ordered_totals(df: DataFrame, order: list, value: Column, out_col: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before this one in ``order`` (which must be total).

    Rows are range-partitioned and written once, so the partitions stay as they
    are; partition totals (one row a partition) give each partition its start.
    """
    ordered = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).withColumn("_v", value), spread=False)
    sizes = ordered.groupBy("_p").agg(F.sum("_v").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ordered.join(F.broadcast(starts), "_p")
            .withColumn(out_col, (F.col("_start") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).cast("long"))
            .drop("_p", "_v", "_start"))


def _matched(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys``, where NULL is a value like any other."""
    table = table.select([F.col(c).alias(f"{c}_t") if c in keys else F.col(c) for c in table.columns])
    on = [rows[c].eqNullSafe(table[f"{c}_t"]) for c in keys]
    return rows.join(table, on).drop(*[f"{c}_t" for c in keys])


def _cut_keys(thin: DataFrame, targets: DataFrame, id_cols: list[str], rows_per_bucket: int) -> DataFrame:
    """(_s, _j, _key, _within, _ties): for each wanted rank, the order key of its row, how many rows of that key come
    before it, and how many rows the key has; ``thin (_s, _h, ids)``, ``targets (_s, _j, _rank, _n)``.

    Buckets are prefixes of the hash.  Each pass counts, inside the buckets that
    hold a cut and are still too large to sort, the buckets three hex digits
    longer (4,096 of each); a stratum of 2^28 rows takes one pass, of 2^40 two.
    """
    wanted, length, parts = targets.where("_rank > 0 AND _rank < _n").withColumn("_b", F.lit("")), 0, []
    while True:
        large = wanted.where(F.col("_n") > rows_per_bucket)
        last = length >= 30 or large.isEmpty()
        small = wanted if last else wanted.where(F.col("_n") <= rows_per_bucket)
        bucketed = thin.withColumn("_b", F.substring("_h", 1, length))
        key = F.struct("_h", *id_cols)
        # One row a key and its count, so that a key of very many rows is one row of the window.
        runs = (_matched(bucketed, small.select("_s", "_b").distinct(), ["_s", "_b"])
                .groupBy("_s", "_b", key.alias("_key")).agg(F.count(F.lit(1)).alias("_ties")))
        inside = Window.partitionBy("_s", "_b").orderBy("_key")
        runs = runs.withColumn("_first", F.sum("_ties").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_ties"))
        at = small.select(F.col("_s").alias("_s2"), F.col("_b").alias("_b2"), "_rank", "_j")
        parts.append(runs.join(at, runs["_s"].eqNullSafe(F.col("_s2")) & (runs["_b"] == F.col("_b2"))
                               & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_ties")))
                     .select("_s", "_j", "_key", (F.col("_rank") - F.col("_first")).alias("_within"), "_ties"))
        if last:
            return reduce(DataFrame.unionByName, parts)
        length += 3
        before = Window.partitionBy("_s", "_b").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        counts = (_matched(bucketed, large.select("_s", "_b").distinct(), ["_s", "_b"])
                  .groupBy("_s", "_b", F.substring("_h", 1, length).alias("_next")).agg(F.count(F.lit(1)).alias("_m"))
                  .withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))))
        wanted = materialize(_matched(counts, large, ["_s", "_b"]).where("_rank >= _before AND _rank < _before + _m")
                             .select("_s", "_j", (F.col("_rank") - F.col("_before")).alias("_rank"),
                                     F.col("_m").alias("_n"), F.col("_next").alias("_b")), spread=False)


def rank_segments(df: DataFrame, id_cols: list[str], seed: int, cuts: dict | DataFrame, by: str | None = None,
                  n: int | None = None, seg_col: str = "_seg", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Index of the rank segment of every row, without sorting or shuffling the table.

    ``cuts`` has for each stratum an ascending list of rank cut points c1 < c2 < …,
    as a dict or as a table (by, n, cuts) with the stratum's row count; a row whose
    rank r (seeded md5 order within its stratum) satisfies c_j <= r < c_{j+1} gets
    segment j (0 before c1).  Splits use one cut, folds the cumulative fold sizes.

    A row's segment follows from comparing its order key (hash, id) with the keys of
    the rows at the cuts.  Those keys, one per cut and stratum, are found by counting
    hash buckets and sorting only the buckets that hold a cut; hash, stratum and ids
    are all that these passes read.  The rows themselves then take one projection;
    with strata, after a join with one row a stratum, which Spark broadcasts as far as
    its size limit allows.
    """
    spark = df.sparkSession
    if by is None:
        only = [int(c) for c in next(iter(cuts.values()))]
        strata = spark.createDataFrame([(0, n if n is not None else df.count(), only)], "_s int, _n long, _cuts array<long>")
        stratum = F.lit(0)
    else:
        stratum = F.col(by)
        if isinstance(cuts, dict):
            kind = StructType([StructField("_s", df.schema[by].dataType), StructField("_cuts", ArrayType(LongType()))])
            given = spark.createDataFrame([(k, [int(c) for c in v]) for k, v in cuts.items()], kind)
            strata = _matched(df.groupBy(stratum.alias("_s")).agg(F.count(F.lit(1)).alias("_n")), given, ["_s"])
        else:
            strata = cuts.select(stratum.alias("_s"), F.col("n").alias("_n"), F.col("cuts").alias("_cuts"))
    targets = materialize(strata.select("_s", "_n", F.posexplode("_cuts").alias("_j", "_rank")), spread=False)
    width = (targets.agg(F.max("_j")).first()[0] or 0) + 1
    thin = df.select(stratum.alias("_s"), hash_key(id_cols, seed).alias("_h"), *id_cols)
    cut = F.struct(F.col("_key").alias("key"), "_within", (F.col("_ties") > 1).alias("tied"))
    found = _cut_keys(thin, targets, id_cols, rows_per_bucket).groupBy("_s").agg(
        *[F.max(F.when(F.col("_j") == j, cut)).alias(f"_k{j}") for j in range(width)])
    none_before = targets.groupBy(F.col("_s").alias("_s2")).agg(F.count_if(F.col("_rank") <= 0).alias("_base"))
    table = materialize(none_before.join(found, F.col("_s2").eqNullSafe(F.col("_s")), "left").drop("_s"), spread=False)
    tied = not table.where(reduce(Column.__or__, [F.coalesce(F.col(f"_k{j}.tied"), F.lit(False)) for j in range(width)])).isEmpty()

    # Without strata there is one row of cuts: constants, and no join.
    keyed = df.withColumn("_h", hash_key(id_cols, seed)).withColumn("_s", stratum)
    own, own_columns = F.struct("_h", *id_cols), [quoted(c) for c in df.columns]
    if by is None:
        row = table.first()
        cuts = [_constant(row[f"_k{j}"], [(c, df.schema[c].dataType) for c in id_cols]) for j in range(width) if row[f"_k{j}"] is not None]
        base = F.lit(row["_base"])
    else:
        keyed = keyed.join(table, keyed["_s"].eqNullSafe(table["_s2"]), "left")
        cuts, base = [F.col(f"_k{j}") for j in range(width)], F.col("_base")

    def segment(rank: Column) -> Column:
        passed = [F.coalesce(((own > c["key"]) | ((own == c["key"]) & (rank >= c["_within"]))).cast("int"), F.lit(0)) for c in cuts]
        return reduce(Column.__add__, passed, base).cast("int").alias(seg_col)

    if not tied:
        return keyed.select(*own_columns, segment(F.lit(0)))
    at_tie = reduce(Column.__or__, [F.coalesce(c["tied"] & (own == c["key"]), F.lit(False)) for c in cuts])
    sortable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType)) and f.name not in id_cols]
    order = [quoted(c) for c in ["_s", "_h", *id_cols, *sortable, "_place"]]
    ties = ordered_totals(keyed.where(at_tie).withColumn("_place", F.monotonically_increasing_id()), order, F.lit(1), "_r")
    first = ties.groupBy(F.col("_s").alias("_fs"), F.col("_h").alias("_fh"), *[F.col(c).alias(f"_f{k}") for k, c in enumerate(id_cols)]).agg(F.min("_r").alias("_r0"))
    same = [F.col("_s").eqNullSafe(F.col("_fs")), F.col("_h") == F.col("_fh"), *[F.col(c).eqNullSafe(F.col(f"_f{k}")) for k, c in enumerate(id_cols)]]
    ranked = ties.join(first, same)
    return keyed.where(~at_tie).select(*own_columns, segment(F.lit(0))).unionByName(ranked.select(*own_columns, segment(F.col("_r") - F.col("_r0"))))


def _constant(cut, ids: list[tuple]) -> Column:
    """A cut (key, _within, tied) as a literal."""
    key = F.struct(F.lit(cut["key"]["_h"]).alias("_h"), *[F.lit(cut["key"][c]).cast(kind).alias(c) for c, kind in ids])
    return F.struct(key.alias("key"), F.lit(cut["_within"]).alias("_within"), F.lit(cut["tied"]).alias("tied"))
