"""Column profiling: counts, null report, describe, value counts, rates, histograms, density.

Everything is a distributed aggregation with partial combine; results are
returned as DataFrames.  Only bounded, fixed-shape statistics (a handful of
numbers per column) travel to the driver, and only where a later pass needs
them as literals (quantile refinement, histogram edges, KDE grid).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, LongType, StringType, StructField, StructType)

from tabwise.errors import PipelineError
from tabwise.functions.columns import is_missing, nan_as_null, numeric_columns, quoted
from tabwise.operators.quantiles import exact_quantiles, modes
from tabwise.operators.ranking import hash_key


# --------------------------------------------------------------------------- A1
def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


# --------------------------------------------------------------------------- A2 / P13
def null_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, null_count) sorted by count desc then name — one pass + unpivot."""
    columns = columns or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    wide = df.agg(*[F.count_if(is_missing(c, types[c])).cast("bigint").alias(c) for c in columns])
    return (wide.unpivot([], columns, "column", "null_count")
            .orderBy(F.desc("null_count"), F.asc("column")))


def schema_listing(df: DataFrame) -> DataFrame:
    """``df.info()``: column, dtype, non-null count (one pass); NaN counts as null."""
    df = nan_as_null(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    wide = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    listing = wide.unpivot([], df.columns, "column", "non_null")
    dtypes = df.sparkSession.createDataFrame([(c, types[c].simpleString()) for c in df.columns],
                                             "column string, dtype string")
    return listing.join(F.broadcast(dtypes), "column")


# --------------------------------------------------------------------------- A3
DESCRIBE_SCHEMA = StructType([
    StructField("column", StringType()), StructField("count", LongType()),
    StructField("mean", DoubleType()), StructField("std", DoubleType()),
    StructField("min", DoubleType()), StructField("p25", DoubleType()),
    StructField("p50", DoubleType()), StructField("p75", DoubleType()),
    StructField("max", DoubleType()),
])


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, exact 25/50/75 % (linear interpolation), max."""
    aggs = []
    for c in columns:
        v = F.col(c)
        aggs += [F.count(v).alias(f"n_{c}"), F.avg(v).alias(f"mean_{c}"),
                 F.stddev_samp(v).alias(f"std_{c}"), F.min(v).alias(f"lo_{c}"),
                 F.max(v).alias(f"hi_{c}")]
    # NaN counts as missing, as in pandas
    data = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    row = data.agg(*aggs).first()
    stats = {c: (row[f"n_{c}"], row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns}
    q = exact_quantiles(data, columns, [0.25, 0.5, 0.75], stats=stats)
    rows = [(c, int(row[f"n_{c}"]), row[f"mean_{c}"], row[f"std_{c}"], row[f"lo_{c}"],
             q[c][0], q[c][1], q[c][2], row[f"hi_{c}"]) for c in columns]
    return df.sparkSession.createDataFrame(rows, DESCRIBE_SCHEMA)


# --------------------------------------------------------------------------- A4
def describe_strings(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, unique, top (most frequent; ties → smallest), freq for text columns."""
    row = df.agg(*[F.count(c).alias(f"n_{c}") for c in columns],
                 *[F.count_distinct(c).alias(f"u_{c}") for c in columns]).first()
    rows = []
    tops = modes(df, columns)
    for c in columns:
        top = tops[c]
        rows.append((c, int(row[f"n_{c}"]), int(row[f"u_{c}"]),
                     None if top is None else str(top[0]), None if top is None else top[1]))
    return df.sparkSession.createDataFrame(
        rows, "column string, count bigint, unique bigint, top string, freq bigint")


def describe_all(df: DataFrame) -> DataFrame:
    """One row a column, in any mix of types: count, unique, top and freq of the others, mean to max of the numbers.

    What does not apply to a column's type is NULL; NaN counts as missing.  Dates,
    booleans and the like are described by their text.
    """
    numbers = numeric_columns(df)
    others = [c for c in df.columns if c not in numbers]
    parts = []
    if others:
        parts.append(describe_strings(df.select(*[quoted(c).cast("string").alias(c) for c in others]), others))
    if numbers:
        parts.append(describe_numeric(df.select(*numbers), numbers))
    if not parts:
        raise PipelineError("No columns to describe")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    kinds = {"unique": "bigint", "top": "string", "freq": "bigint", **{c: "double" for c in ("mean", "std", "min", "p25", "p50", "p75", "max")}}
    return both.select("column", "count", *[F.col(c) if c in both.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])


# --------------------------------------------------------------------------- A5 / A6
def value_counts(df: DataFrame, column: str, order: str = "count") -> DataFrame:
    """Group sizes without NULLs, by count desc (ties by value) or by value."""
    df = nan_as_null(df, [column])
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("count"))
    if order == "count":
        return counts.orderBy(F.desc("count"), F.asc(column))
    return counts.orderBy(column)


def class_shares(df: DataFrame, column: str) -> DataFrame:
    """value_counts(normalize=True): share of each non-null value."""
    counts = value_counts(df, column)
    total = nan_as_null(df, [column]).where(F.col(column).isNotNull()).count()
    return counts.withColumn("share", F.col("count") / F.lit(float(total) if total else None))


# --------------------------------------------------------------------------- A7 / A8
def rate_and_count(df: DataFrame, predicates: dict) -> DataFrame:
    """Per named predicate: count_if and mean (NULL counts as False), one pass."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for name, pred in predicates.items():
        p = F.coalesce(pred, F.lit(False))
        aggs += [F.count_if(p).alias(f"{name}_count"), F.avg(p.cast("double")).alias(f"{name}_rate")]
    return df.agg(*aggs)


# --------------------------------------------------------------------------- A15 / A16
def histogram(df: DataFrame, column: str, bins: int = 30, lo: float | None = None,
              hi: float | None = None) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed; empty bins included, NULL and NaN left out."""
    df = nan_as_null(df, [column])
    if lo is None or hi is None:
        row = df.agg(F.min(F.col(column).cast("double")), F.max(F.col(column).cast("double"))).first()
        lo, hi = row[0], row[1]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, count bigint")
    width = (hi - lo) if hi != lo else 1.0
    idx = bin_index(F.col(column).cast("double"), lo, hi, bins)
    counts = (df.select(idx.alias("bin")).where(F.col("bin").isNotNull())
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    edges = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    edges = edges.select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width) / F.lit(bins)).alias("bin_lo"),
                         (F.lit(lo) + F.col("bin") * F.lit(width) / F.lit(bins)).alias("bin_hi"))
    return (edges.join(counts, "bin", "left")
            .select("bin", "bin_lo", "bin_hi", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
            .orderBy("bin"))


def bin_index(v, lo: float, hi: float, bins: int):
    """1-based equal-width bin; the maximum falls in the last bin; constant data → bin 1."""
    if hi == lo:
        return F.when(v.isNotNull(), F.lit(1))
    raw = F.floor((v - F.lit(lo)) * F.lit(bins) / F.lit(hi - lo)).cast("int") + 1
    return F.when(v.isNotNull(), F.least(raw, F.lit(bins)))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Binned pair counts for a scatter matrix cell (non-empty cells only), NULL and NaN left out."""
    df = nan_as_null(df, [x, y])
    row = df.agg(F.min(F.col(x).cast("double")), F.max(F.col(x).cast("double")),
                 F.min(F.col(y).cast("double")), F.max(F.col(y).cast("double"))).first()
    bx = bin_index(F.col(x).cast("double"), row[0], row[1], bins)
    by = bin_index(F.col(y).cast("double"), row[2], row[3], bins)
    return (df.select(bx.alias("x_bin"), by.alias("y_bin"))
            .where(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
            .groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count")))


def scatter_matrix(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """Binned pair counts of every pair of columns, and each column's own counts on the diagonal, in one aggregation.

    (x_column, y_column, x_bin, y_bin, count) for columns in the given order, non-empty cells only.
    A row counts in the pairs of which it has both values; NaN counts as missing.
    """
    data = nan_as_null(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    ends = data.agg(*[f(c).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, f in (("lo", F.min), ("hi", F.max))]).first()
    places = [bin_index(F.col(c), ends[f"lo_{i}"], ends[f"hi_{i}"], bins) if ends[f"lo_{i}"] is not None else F.lit(None).cast("int")
              for i, c in enumerate(columns)]
    cells = [F.struct(F.lit(columns[i]).alias("x_column"), F.lit(columns[j]).alias("y_column"),
                      places[i].alias("x_bin"), places[j].alias("y_bin"))
             for i in range(len(columns)) for j in range(i, len(columns))]
    return (data.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
            .where("x_bin IS NOT NULL AND y_bin IS NOT NULL")
            .groupBy("x_column", "y_column", "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count")))


# --------------------------------------------------------------------------- A17
def density_grid(df: DataFrame, column: str, points: int = 50) -> DataFrame:
    """Gaussian KDE on an even grid over [min, max], bandwidth σ·n^(-1/5) (Scott).

    Two passes, no join: pass 1 gets n/σ/min/max; pass 2 evaluates every grid
    point as its own ``avg`` aggregate in a single HashAggregate, so the work is
    O(n · points) in codegen with no row amplification or pair generation.
    Output ``kernel_mean`` = mean of exp(-½u²); ``density`` divides by h·√(2π).
    NULL and NaN are left out.
    """
    df = nan_as_null(df, [column])
    v = F.col(column).cast("double")
    s = df.agg(F.count(v).alias("n"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"),
               F.max(v).alias("hi")).first()
    spark = df.sparkSession
    if not s["n"] or s["sd"] is None or s["sd"] == 0:
        return spark.createDataFrame([], "grid_index int, grid_x double, kernel_mean double, density double")
    h = s["sd"] * math.pow(s["n"], -0.2)
    grid = [s["lo"] + i * (s["hi"] - s["lo"]) / (points - 1) for i in range(points)]
    aggs = [F.avg(F.exp(F.lit(-0.5) * F.pow((F.lit(g) - v) / F.lit(h), 2))).alias(f"g{i}")
            for i, g in enumerate(grid)]
    wide = df.where(v.isNotNull()).agg(*aggs)
    long = wide.unpivot([], [f"g{i}" for i in range(points)], "g", "kernel_mean")
    norm = h * math.sqrt(2 * math.pi)
    gx = F.element_at(F.array(*[F.lit(g) for g in grid]), F.substring("g", 2, 10).cast("int") + 1)
    return long.select(F.substring("g", 2, 10).cast("int").alias("grid_index"), gx.alias("grid_x"),
                       "kernel_mean", (F.col("kernel_mean") / F.lit(norm)).alias("density"))


# --------------------------------------------------------------------------- L1 / L7
def head(df: DataFrame, order_col: str, n: int = 5) -> DataFrame:
    return df.orderBy(F.asc(order_col)).limit(n)


def tail(df: DataFrame, order_col: str, n: int = 5) -> DataFrame:
    return df.orderBy(F.desc(order_col)).limit(n)


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n pseudo-random rows: top-n by md5(seed:id) (distributed top-k)."""
    return (df.withColumn("_h", hash_key([id_col], seed)).orderBy("_h", id_col).limit(n).drop("_h"))


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession
