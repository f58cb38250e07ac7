"""Pearson and Spearman correlation matrices, and correlation with a target.

Pearson: every pair is a ``corr`` aggregate in ONE pass (pairwise-complete
NULL handling, like pandas).  Spearman: exact average ranks per column from
distinct-value counts (``average_ranks``), then Pearson on the ranks.  (Spark
ML's built-in Spearman averages ties only within a partition, so a tie run
that crosses a partition boundary — or exceeds 10^7 rows — is ranked
inexactly; we do not use it.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwise.errors import PipelineError
from tabwise.session import materialize


def _number(column: str):
    """The column as a double, NaN as missing."""
    return F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None).cast("double"))


def safe_corr(a, b):
    """Pearson correlation over the rows where both are present; NULL if either is constant there."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long-format matrix (col_a, col_b, corr) for every ordered pair; NULL for constant or empty columns."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    varies = [F.when(F.stddev_pop(_number(c)) > 0, 1.0).alias(f"d{i}") for i, c in enumerate(columns)]
    row = df.agg(*varies, *[safe_corr(_number(columns[i]), _number(columns[j])).alias(f"{i}_{j}") for i, j in pairs]).first() if columns else None
    rows = [(c, c, row[f"d{i}"]) for i, c in enumerate(columns)]
    for i, j in pairs:
        rows += [(columns[i], columns[j], row[f"{i}_{j}"]), (columns[j], columns[i], row[f"{i}_{j}"])]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


def corr_with_target(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Correlation of each column with ``target`` (self excluded), ascending; NULL for constant columns."""
    others = [c for c in columns if c != target]
    row = df.agg(*[safe_corr(_number(c), _number(target)).alias(f"c{i}") for i, c in enumerate(others)]).first() if others else None
    out = df.sparkSession.createDataFrame([(c, row[f"c{i}"]) for i, c in enumerate(others)], "column string, corr double")
    return out.orderBy(F.asc("corr"), F.asc("column"))


RANK_BROADCAST_ROWS = 1 << 20


def rank_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(k, v, rank): exact 1-based average ranks of every distinct value of every column.

    rank(v) = #(values < v) + (count(v) + 1) / 2 within its column.  All columns
    are stacked as (column index k, value v) and reduced to distinct counts with
    map-side combine — a value holding a third of all rows becomes one row —
    then range-partitioned on (k, v) and written once (freezing the range
    assignment).  Per-(partition, k) totals give offsets; a window inside each
    (partition, k) gives the running count below each value.
    """
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("double").alias("v"))
                                            for i, c in enumerate(columns)])).alias("s")).select("s.*")
    vals = stacked.where(F.col("v").isNotNull()).groupBy("k", "v").agg(F.count(F.lit(1)).alias("_n"))
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    ranged = materialize(vals.repartitionByRange(parts, "k", "v").withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("k", "_p").agg(F.sum("_n").alias("_tot"))   # ≤ columns × partitions rows
    offs = sizes.select("k", "_p", F.coalesce(F.sum("_tot").over(
        Window.partitionBy("k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    below = Window.partitionBy("_p", "k").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.join(F.broadcast(offs), ["k", "_p"])
            .select("k", "v", (F.col("_off") + F.coalesce(F.sum("_n").over(below), F.lit(0))
                               + (F.col("_n") + F.lit(1)) / F.lit(2.0)).alias("rank")))


def attach_ranks(df: DataFrame, columns: list[str], prefix: str = "_r") -> DataFrame:
    """Add ``{prefix}{i}`` = average rank of ``columns[i]`` (NULL stays NULL).

    The rank table joins back by value, broadcast when its row count is within a
    fixed bound, otherwise as a shuffle join (AQE splits a hot value's partition).
    """
    ranks = materialize(rank_table(df, columns))
    small = ranks.count() <= RANK_BROADCAST_ROWS
    out = df
    for i, c in enumerate(columns):
        r = ranks.where(F.col("k") == i).select(F.col("v").alias(f"_v{i}"), F.col("rank").alias(f"{prefix}{i}"))
        out = out.join(F.broadcast(r) if small else r, F.col(c).cast("double") == F.col(f"_v{i}"), "left") \
            .drop(f"_v{i}")
    return out


def average_ranks(df: DataFrame, column: str, out_col: str) -> DataFrame:
    """Exact average ranks of one column (see ``rank_table``)."""
    return attach_ranks(df, [column], "_rk").withColumnRenamed("_rk0", out_col)


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spearman rank correlation (average ranks on ties), pairwise-complete like pandas.

    Ranks come from ``average_ranks`` (exact at any scale, including ties that
    span partitions), then Pearson on ranks in one aggregation.  Without NULLs
    one rank per column serves every pair; with NULLs each pair is ranked on
    its own complete rows.
    """
    data = df.select([F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
                      for c in columns])
    facts = data.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
                     *[F.when(F.stddev_pop(c) > 0, 1.0).alias(f"_d{i}") for i, c in enumerate(columns)]).first()
    nulls = {c: facts[c] for c in columns}
    spark = df.sparkSession
    rows = [(c, c, facts[f"_d{i}"]) for i, c in enumerate(columns)]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    if not any(nulls[c] for c in columns):
        ranked = attach_ranks(data, columns, "_r")
        row = ranked.agg(*[safe_corr(F.col(f"_r{columns.index(a)}"), F.col(f"_r{columns.index(b)}")).alias(f"{a}|{b}")
                           for a, b in pairs]).first() if pairs else None
        for a, b in pairs:
            rows += [(a, b, row[f"{a}|{b}"]), (b, a, row[f"{a}|{b}"])]
    else:
        for a, b in pairs:
            pair = data.select(a, b).dropna()
            ranked = attach_ranks(pair, [a, b], "_r")
            v = ranked.agg(safe_corr(F.col("_r0"), F.col("_r1"))).first()[0]
            rows += [(a, b, v), (b, a, v)]
    return spark.createDataFrame(rows, "col_a string, col_b string, corr double")
