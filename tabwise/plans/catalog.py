"""Registered queries over the driver tables, each with its SQL twin.

Each query maps one or more reference operators (SURVEY §2 ids in the
docstring) onto the TPC-H-style tables.  ``QUERIES[name](spark, sf_dir)``
returns a DataFrame; ``ORACLE_SQL[name]`` is the same computation in plain SQL
(DuckDB dialect) over the same tables.  Doubles are rounded identically on
both sides so float summation order cannot flip a comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer

from tabwise.operators import cluster as CL
from tabwise.operators import correlation as CO
from tabwise.operators import encoding as EN
from tabwise.operators import metrics as ME
from tabwise.operators import prep as PR
from tabwise.operators import profile as PF
from tabwise.operators import split as SP
from tabwise.operators.quantiles import exact_quantiles, modes
from tabwise.plans import tables as T
from tabwise.session import materialize
from tabwise.sources.tables import TABLE_NAMES, catalog_counts, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def r(c, d: int):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


SEED = 42
LINEITEM_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]  # driver data domain

# =============================================================================== S2
_NCOLS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6,
          "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3,
          "benchmark": 2, "labels": 3, "conversations": 4}


@register("catalog_counts", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST({_NCOLS[t]} AS BIGINT) AS n_cols FROM {t}"
    for t in TABLE_NAMES))
def q_catalog_counts(spark, sf_dir):
    """Row and column count for every registered dataset."""
    return catalog_counts(spark, {t: read_table(spark, sf_dir, t) for t in TABLE_NAMES})


# =============================================================================== A2 / S5
_OG_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("null_report", f"WITH {T.ORDERS_WITH_GAPS_SQL}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM og"
    for c in _OG_COLS))
def q_null_report(spark, sf_dir):
    """A2: NULL count per column, sorted descending (S5's detection pass)."""
    return PF.null_report(T.orders_with_gaps(spark, sf_dir)).withColumnRenamed("column", "column_name")


# =============================================================================== A3
def _describe_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, "
            f"round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min_value, "
            f"round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, "
            f"round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max_value FROM {table}")
    return "\nUNION ALL\n".join(parts)


def _describe_rounded(df: DataFrame) -> DataFrame:
    return df.select(F.col("column").alias("column_name"), F.col("count").alias("n"),
                     r("mean", 4).alias("mean"), r("std", 4).alias("std"),
                     r("min", 4).alias("min_value"), r("p25", 4).alias("p25"), r("p50", 4).alias("p50"),
                     r("p75", 4).alias("p75"), r("max", 4).alias("max_value"))


@register("describe_numeric", _describe_sql("lineitem", LINEITEM_NUM))
def q_describe_numeric(spark, sf_dir):
    """A3: count/mean/std/min/exact quartiles/max of lineitem's measures."""
    return _describe_rounded(PF.describe_numeric(read_table(spark, sf_dir, "lineitem"), LINEITEM_NUM))


@register("describe_orders_gaps", "WITH " + T.ORDERS_WITH_GAPS_SQL + "\n" + _describe_sql("og", ["o_totalprice", "o_custkey"]))
def q_describe_orders_gaps(spark, sf_dir):
    """A3 with NULLs present (ignored by every statistic)."""
    return _describe_rounded(PF.describe_numeric(T.orders_with_gaps(spark, sf_dir), ["o_totalprice", "o_custkey"]))


# =============================================================================== A4
_PART_TEXT = ["p_brand", "p_type", "p_name"]


@register("describe_strings", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, (SELECT count({c}) FROM part) AS n, "
    f"(SELECT count(DISTINCT {c}) FROM part) AS n_unique, t.v AS top, t.c AS freq FROM "
    f"(SELECT {c} AS v, count(*) AS c FROM part WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY c DESC, v LIMIT 1) t"
    for c in _PART_TEXT))
def q_describe_strings(spark, sf_dir):
    """A4: count, unique, top, freq for text columns."""
    d = PF.describe_strings(read_table(spark, sf_dir, "part"), _PART_TEXT)
    return d.select(F.col("column").alias("column_name"), F.col("count").alias("n"),
                    F.col("unique").alias("n_unique"), "top", "freq")


_PART_NUMBERS = ["p_partkey", "p_size", "p_retailprice"]


@register("describe_all", "\nUNION ALL\n".join(
    [f"SELECT '{c}' AS column_name, (SELECT count({c}) FROM part) AS n, (SELECT count(DISTINCT {c}) FROM part) AS n_unique, t.v AS top, "
     f"t.c AS freq, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS lo, NULL::DOUBLE AS p25, NULL::DOUBLE AS p50, "
     f"NULL::DOUBLE AS p75, NULL::DOUBLE AS hi FROM "
     f"(SELECT {c} AS v, count(*) AS c FROM part WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY c DESC, v LIMIT 1) t" for c in _PART_TEXT] +
    [f"SELECT '{c}', count({c}), NULL, NULL, NULL, round(avg({c}), 4), round(stddev_samp({c}), 4), min({c})::DOUBLE, "
     + ", ".join(f"round(quantile_cont({c}::DOUBLE, {p}), 4)" for p in (0.25, 0.5, 0.75)) + f", max({c})::DOUBLE FROM part"
     for c in _PART_NUMBERS]))
def q_describe_all(spark, sf_dir):
    """A4: text and number columns described in one table."""
    d = PF.describe_all(read_table(spark, sf_dir, "part").select(*_PART_TEXT, *_PART_NUMBERS))
    return d.select(F.col("column").alias("column_name"), F.col("count").alias("n"), F.col("unique").alias("n_unique"), "top", "freq",
                    r("mean", 4).alias("mean"), r("std", 4).alias("std"), F.col("min").alias("lo"), r("p25", 4).alias("p25"),
                    r("p50", 4).alias("p50"), r("p75", 4).alias("p75"), F.col("max").alias("hi"))


# =============================================================================== A5 / A6
@register("value_counts", "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL "
                          "GROUP BY event_type")
def q_value_counts(spark, sf_dir):
    """A5: group sizes by count desc (NULLs excluded)."""
    return PF.value_counts(read_table(spark, sf_dir, "events"), "event_type").withColumnRenamed("count", "n")


@register("value_counts_gaps", f"WITH {T.ORDERS_WITH_GAPS_SQL}\nSELECT o_orderpriority, count(*) AS n "
                               "FROM og WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def q_value_counts_gaps(spark, sf_dir):
    """A5 ordered by key, with NULLs present and excluded."""
    return (PF.value_counts(T.orders_with_gaps(spark, sf_dir), "o_orderpriority", order="key")
            .withColumnRenamed("count", "n"))


@register("class_shares", "SELECT o_orderstatus, count(*) AS n, "
                          "round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders "
                          "WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus")
def q_class_shares(spark, sf_dir):
    """Normalised value counts."""
    s = PF.class_shares(T.orders(spark, sf_dir), "o_orderstatus")
    return s.select("o_orderstatus", F.col("count").alias("n"), r("share", 6).alias("share"))


# =============================================================================== A7
@register("rate_and_conditional_count",
          "SELECT count(*) AS n_rows, count(*) FILTER (WHERE quality = 1) AS quality_count, "
          "round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS quality_rate, "
          "count(*) FILTER (WHERE toxic = 1) AS toxic_count, "
          "round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 6) AS toxic_rate FROM labels")
def q_rate_and_conditional_count(spark, sf_dir):
    """Conditional counts and positive-class rates (NULL counts as False)."""
    lab = read_table(spark, sf_dir, "labels")
    out = PF.rate_and_count(lab, {"quality": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    return out.select("n_rows", "quality_count", r("quality_rate", 6).alias("quality_rate"),
                      "toxic_count", r("toxic_rate", 6).alias("toxic_rate"))


# =============================================================================== A8–A10 / A26
@register("central_tendency", f"""WITH {T.ORDERS_WITH_GAPS_SQL}
SELECT round(avg(o_totalprice), 4) AS mean_totalprice,
       round(quantile_cont(o_totalprice, 0.5), 4) AS median_totalprice,
       round(quantile_cont(o_custkey, 0.5), 4) AS median_custkey,
       (SELECT o_orderpriority FROM og WHERE o_orderpriority IS NOT NULL GROUP BY 1
        ORDER BY count(*) DESC, o_orderpriority LIMIT 1) AS mode_priority,
       (SELECT o_orderstatus FROM og WHERE o_orderstatus IS NOT NULL GROUP BY 1
        ORDER BY count(*) DESC, o_orderstatus LIMIT 1) AS mode_status
FROM og""")
def q_central_tendency(spark, sf_dir):
    """A8 mean, A9 exact median (mean of middle pair), A10 mode (ties → smallest), A26 defaults."""
    og = T.orders_with_gaps(spark, sf_dir)
    mean = og.agg(F.avg("o_totalprice")).first()[0]
    med = exact_quantiles(og, ["o_totalprice", "o_custkey"], [0.5])
    mo = modes(og, ["o_orderpriority", "o_orderstatus"])
    row = (round(mean, 4), round(med["o_totalprice"][0], 4), round(med["o_custkey"][0], 4),
           mo["o_orderpriority"][0], mo["o_orderstatus"][0])
    return spark.createDataFrame([row], "mean_totalprice double, median_totalprice double, "
                                        "median_custkey double, mode_priority string, mode_status string")


# =============================================================================== A11
@register("distinct_values", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def q_distinct_values(spark, sf_dir):
    """Distinct combinations."""
    return read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


# =============================================================================== A12 / A14 / A13
def _pearson_sql(table: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM {table}"
        for a in cols for b in cols)


@register("corr_pearson", _pearson_sql("lineitem", LINEITEM_NUM))
def q_corr_pearson(spark, sf_dir):
    """Pearson matrix, pairwise-complete, one pass."""
    m = CO.pearson_matrix(read_table(spark, sf_dir, "lineitem"), LINEITEM_NUM)
    return m.select("col_a", "col_b", r("corr", 6).alias("corr"))


@register("corr_target", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, round(corr({c}, l_extendedprice), 6) AS corr FROM lineitem"
    for c in LINEITEM_NUM if c != "l_extendedprice"))
def q_corr_target(spark, sf_dir):
    """Correlation of each feature with the target, ascending, self excluded."""
    c = CO.corr_with_target(read_table(spark, sf_dir, "lineitem"), "l_extendedprice", LINEITEM_NUM)
    return c.select(F.col("column").alias("column_name"), r("corr", 6).alias("corr"))


_SPEAR = ["p_size", "p_retailprice", "p_partkey"]


def _spearman_sql() -> str:
    ranks = ",\n".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in _SPEAR)
    body = "\nUNION ALL\n".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(r_{a}, r_{b}), 6) AS corr FROM rk"
        for a in _SPEAR for b in _SPEAR)
    return f"WITH rk AS (SELECT {ranks} FROM part)\n{body}"


@register("corr_spearman", _spearman_sql())
def q_corr_spearman(spark, sf_dir):
    """Spearman with average ranks on ties (distributed rank by sort)."""
    m = CO.spearman_matrix(read_table(spark, sf_dir, "part"), _SPEAR)
    return m.select("col_a", "col_b", r("corr", 6).alias("corr"))


# =============================================================================== A15 / A16 / A17
@register("histogram_30", """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
idx AS (SELECT LEAST(CAST(floor((o_totalprice - lo) * 30 / (hi - lo)) AS INTEGER) + 1, 30) AS bin
        FROM orders, b WHERE o_totalprice IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM idx GROUP BY bin),
g AS (SELECT CAST(i AS INTEGER) AS bin FROM range(1, 31) t(i))
SELECT g.bin, round(lo + (g.bin - 1) * (hi - lo) / 30, 4) AS bin_lo,
       round(lo + g.bin * (hi - lo) / 30, 4) AS bin_hi, coalesce(c.n, 0) AS n
FROM g CROSS JOIN b LEFT JOIN c ON g.bin = c.bin""")
def q_histogram_30(spark, sf_dir):
    """30 equal-width bins, last bin closed, empty bins kept."""
    h = PF.histogram(T.orders(spark, sf_dir), "o_totalprice", 30)
    return h.select("bin", r("bin_lo", 4).alias("bin_lo"), r("bin_hi", 4).alias("bin_hi"),
                    F.col("count").alias("n"))


@register("histogram_2d", """WITH b AS (SELECT min(l_quantity) AS xlo, max(l_quantity) AS xhi,
  min(l_discount) AS ylo, max(l_discount) AS yhi FROM lineitem)
SELECT LEAST(CAST(floor((l_quantity - xlo) * 10 / (xhi - xlo)) AS INTEGER) + 1, 10) AS x_bin,
       LEAST(CAST(floor((l_discount - ylo) * 10 / (yhi - ylo)) AS INTEGER) + 1, 10) AS y_bin,
       count(*) AS n
FROM lineitem, b GROUP BY 1, 2""")
def q_histogram_2d(spark, sf_dir):
    """Binned pair counts behind a scatter-matrix cell."""
    return PF.histogram_2d(read_table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", 10) \
        .withColumnRenamed("count", "n")


_SCATTER = ["l_quantity", "l_discount", "l_extendedprice"]


@register("scatter_matrix", "WITH e AS (SELECT " + ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(_SCATTER))
          + " FROM lineitem),\nb AS (SELECT "
          + ", ".join(f"LEAST(CAST(floor(({c} - lo{i}) * 10 / (hi{i} - lo{i})) AS INTEGER) + 1, 10) AS b{i}" for i, c in enumerate(_SCATTER))
          + " FROM lineitem, e)\n" + "\nUNION ALL\n".join(
              f"SELECT '{x}' AS x_column, '{y}' AS y_column, b{i} AS x_bin, b{j} AS y_bin, count(*) AS n FROM b GROUP BY b{i}, b{j}"
              if i != j else f"SELECT '{x}', '{x}', b{i}, b{i}, count(*) FROM b GROUP BY b{i}"
              for i, x in enumerate(_SCATTER) for j, y in enumerate(_SCATTER) if i <= j)
          .replace("SELECT 'l_quantity', 'l_quantity', b0, b0, count(*)",
                   "SELECT 'l_quantity' AS x_column, 'l_quantity' AS y_column, b0 AS x_bin, b0 AS y_bin, count(*) AS n", 1))
def q_scatter_matrix(spark, sf_dir):
    """Every pair of three columns binned, with marginals on the diagonal."""
    return PF.scatter_matrix(read_table(spark, sf_dir, "lineitem"), _SCATTER, 10).withColumnRenamed("count", "n")


@register("density_grid", """WITH s AS (SELECT count(c_acctbal) AS n, stddev_samp(c_acctbal) AS sd,
  min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),
p AS (SELECT sd * pow(n, -0.2) AS h, lo, hi FROM s),
g AS (SELECT CAST(i AS INTEGER) AS grid_index, lo + (i * (hi - lo)) / 49 AS gx, h FROM p, range(0, 50) t(i)),
k AS (SELECT grid_index, gx, h, avg(exp(-0.5 * pow((gx - c_acctbal) / h, 2))) AS km
      FROM g, customer WHERE c_acctbal IS NOT NULL GROUP BY grid_index, gx, h)
SELECT grid_index, round(gx, 4) AS grid_x, round(km, 6) AS kernel_mean,
       round(km / (h * sqrt(2 * pi())), 10) AS density FROM k""")
def q_density_grid(spark, sf_dir):
    """Gaussian KDE (Scott bandwidth) on a 50-point grid."""
    d = PF.density_grid(read_table(spark, sf_dir, "customer"), "c_acctbal", 50)
    return d.select("grid_index", r("grid_x", 4).alias("grid_x"), r("kernel_mean", 6).alias("kernel_mean"),
                    r("density", 10).alias("density"))


# =============================================================================== T1
@register("impute_mode_median", f"""WITH {T.ORDERS_WITH_GAPS_SQL},
pm AS (SELECT o_orderpriority AS v FROM og WHERE o_orderpriority IS NOT NULL GROUP BY 1
       ORDER BY count(*) DESC, v LIMIT 1),
sm AS (SELECT o_orderstatus AS v FROM og WHERE o_orderstatus IS NOT NULL GROUP BY 1
       ORDER BY count(*) DESC, v LIMIT 1),
md AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM og)
SELECT o_orderkey, coalesce(o_orderstatus, (SELECT v FROM sm)) AS o_orderstatus,
       round(coalesce(o_totalprice, (SELECT m FROM md)), 2) AS o_totalprice,
       coalesce(o_orderpriority, (SELECT v FROM pm)) AS o_orderpriority
FROM og""")
def q_impute_mode_median(spark, sf_dir):
    """Mode for categories, exact median for the amount; whole table."""
    og = T.orders_with_gaps(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_totalprice",
                                                   "o_orderpriority")
    out, _ = PR.impute(og, mode_cols=["o_orderstatus", "o_orderpriority"], median_cols=["o_totalprice"])
    return out.withColumn("o_totalprice", r("o_totalprice", 2))


# =============================================================================== T2 / T8
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]  # driver data domain


@register("one_hot", f"WITH {T.CUSTOMER_WITH_GAPS_SQL}\nSELECT c_custkey, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS c_mktsegment_{s}" for s in _SEGMENTS)
    + " FROM cg")
def q_one_hot(spark, sf_dir):
    """Dummies per sorted category, NULL → all zeros, other columns first."""
    cg = T.customer_with_gaps(spark, sf_dir).select("c_custkey", "c_mktsegment")
    out, _ = PR.one_hot(cg, ["c_mktsegment"])
    return out


@register("score_time_encoding", f"""WITH {T.CUSTOMER_WITH_GAPS_SQL},
c AS (SELECT c_mktsegment AS k, count(*) AS cnt FROM cg GROUP BY 1),
tot AS (SELECT sum(cnt) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * sum(cnt)) AS BIGINT) AS n_test FROM c),
rk AS (SELECT c_custkey, c_mktsegment,
              row_number() OVER (ORDER BY {T.md5_key_sql(SEED, 'c_custkey')}, c_custkey) - 1 AS r FROM cg),
sp AS (SELECT rk.*, CASE WHEN r < n_test THEN 'test' ELSE 'train' END AS split FROM rk, tot),
cats AS (SELECT DISTINCT c_mktsegment AS v FROM sp WHERE split = 'train' AND c_mktsegment IS NOT NULL)
SELECT c_custkey, split,
       CASE WHEN c_mktsegment IN (SELECT v FROM cats) THEN 'c_mktsegment_' || c_mktsegment END AS active_dummy,
       CASE WHEN c_mktsegment IN (SELECT v FROM cats) THEN 1 ELSE 0 END AS n_active,
       CAST((SELECT count(*) FROM cats) AS BIGINT) AS n_dummies
FROM sp""")
def q_score_time_encoding(spark, sf_dir):
    """Categories stored from training rows only, applied to every row (unseen/NULL → zeros)."""
    cg = T.customer_with_gaps(spark, sf_dir).select("c_custkey", "c_mktsegment")
    sp = SP.train_test_split(cg, "c_custkey", None, 0.2, SEED)
    model = PR.fit_one_hot(sp.where(F.col("split") == "train"), ["c_mktsegment"])
    enc = PR.apply_one_hot(sp, model)
    dummies = [c for c in enc.columns if c.startswith("c_mktsegment_")]
    active = F.coalesce(*[F.when(F.col(d) == 1, F.lit(d)) for d in dummies]) if dummies else F.lit(None)
    n_active = sum((F.col(d) for d in dummies), F.lit(0))
    return enc.select("c_custkey", "split", active.cast("string").alias("active_dummy"),
                      n_active.cast("int").alias("n_active"), F.lit(len(dummies)).cast("bigint").alias("n_dummies"))


# =============================================================================== T3 / T4 / A27 / J3
def _strat_quota_sql(table: str, label: str, test_size: float = 0.2) -> str:
    return f"""c AS (SELECT {label} AS k, count(*) AS cnt FROM {table} GROUP BY 1),
tot AS (SELECT sum(cnt) AS n, CAST(ceil(CAST({test_size} AS DOUBLE) * sum(cnt)) AS BIGINT) AS n_test FROM c),
q AS (SELECT k, cnt, (cnt * (n - n_test)) // n AS base, (cnt * (n - n_test)) % n AS rem, n, n_test FROM c, tot),
q2 AS (SELECT *, row_number() OVER (ORDER BY rem DESC, k) AS rr, (n - n_test) - sum(base) OVER () AS leftover FROM q),
quota AS (SELECT k, cnt - (base + CASE WHEN rr <= leftover THEN 1 ELSE 0 END) AS test_q FROM q2)"""


_STRAT_SPLIT_SQL = f"""WITH {_strat_quota_sql('orders', 'o_orderstatus')},
rk AS (SELECT o_orderkey, o_orderstatus, o_totalprice,
              row_number() OVER (PARTITION BY o_orderstatus ORDER BY {T.md5_key_sql(SEED, 'o_orderkey')}, o_orderkey) - 1 AS r
       FROM orders),
sp AS (SELECT rk.o_orderkey, rk.o_orderstatus, rk.o_totalprice,
              CASE WHEN r < test_q THEN 'test' ELSE 'train' END AS split
       FROM rk JOIN quota ON rk.o_orderstatus = quota.k)"""


@register("stratified_split", _STRAT_SPLIT_SQL + "\nSELECT o_orderkey, o_orderstatus, split FROM sp")
def q_stratified_split(spark, sf_dir):
    """Exact-size stratified split (largest-remainder quotas, seeded md5 order)."""
    o = T.orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    return SP.train_test_split(o, "o_orderkey", "o_orderstatus", 0.2, SEED)


@register("split_report", _STRAT_SPLIT_SQL + """,
tr AS (SELECT o_orderstatus, count(*) AS n FROM sp WHERE split = 'train' GROUP BY 1),
te AS (SELECT o_orderstatus, count(*) AS n FROM sp WHERE split = 'test' GROUP BY 1)
SELECT coalesce(tr.o_orderstatus, te.o_orderstatus) AS o_orderstatus,
       coalesce(tr.n, 0) AS n_train, coalesce(te.n, 0) AS n_test,
       round(coalesce(tr.n, 0) / (SELECT sum(n) FROM tr), 6) AS train_share,
       round(coalesce(te.n, 0) / (SELECT sum(n) FROM te), 6) AS test_share
FROM tr FULL OUTER JOIN te ON tr.o_orderstatus = te.o_orderstatus""")
def q_split_report(spark, sf_dir):
    """A27 split shapes + J3 class shares per side (full outer join on the class)."""
    o = T.orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    sp = SP.train_test_split(o, "o_orderkey", "o_orderstatus", 0.2, SEED).cache()
    return split_report(sp, "o_orderstatus")


def split_report(sp: DataFrame, label: str) -> DataFrame:
    sides = sp.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))
    tr = sides.where(F.col("split") == "train").select(label, F.col("n").alias("n_train"))
    te = sides.where(F.col("split") == "test").select(label, F.col("n").alias("n_test"))
    totals = {row["split"]: row["t"] for row in sp.groupBy("split").agg(F.count(F.lit(1)).alias("t")).collect()}
    out = tr.join(te, label, "full")
    return out.select(label, F.coalesce("n_train", F.lit(0)).alias("n_train"),
                      F.coalesce("n_test", F.lit(0)).alias("n_test"),
                      r(F.coalesce("n_train", F.lit(0)) / F.lit(float(totals.get("train", 0))), 6).alias("train_share"),
                      r(F.coalesce("n_test", F.lit(0)) / F.lit(float(totals.get("test", 0))), 6).alias("test_share"))


@register("plain_split", f"""WITH tot AS (SELECT CAST(ceil(CAST(0.25 AS DOUBLE) * count(*)) AS BIGINT) AS n_test FROM customer),
rk AS (SELECT c_custkey, row_number() OVER (ORDER BY {T.md5_key_sql(7, 'c_custkey')}, c_custkey) - 1 AS r FROM customer)
SELECT c_custkey, CASE WHEN r < n_test THEN 'test' ELSE 'train' END AS split FROM rk, tot""")
def q_plain_split(spark, sf_dir):
    """T4 without a stratum: one global stratum, exact sizes."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey")
    return SP.train_test_split(c, "c_custkey", None, 0.25, 7)


# =============================================================================== T5
_MM_SPLIT = f"""WITH tot AS (SELECT CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS n_test FROM lineitem),
rk AS (SELECT l_orderkey, l_linenumber, {', '.join(LINEITEM_NUM)},
              row_number() OVER (ORDER BY {T.md5_key_sql(SEED, 'l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber,
                                      {', '.join(f'{c} NULLS FIRST' for c in LINEITEM_NUM)}) - 1 AS r
       FROM lineitem),
sp AS (SELECT rk.*, CASE WHEN r < n_test THEN 'test' ELSE 'train' END AS split FROM rk, tot),
mm AS (SELECT {', '.join(f'min({c}) AS mn_{c}, max({c}) AS mx_{c}' for c in LINEITEM_NUM)} FROM sp WHERE split = 'train')"""


@register("minmax_train_only", _MM_SPLIT + "\nSELECT l_orderkey, l_linenumber, split, " + ", ".join(
    f"round(({c} - mn_{c}) / CASE WHEN mx_{c} = mn_{c} THEN 1.0 ELSE mx_{c} - mn_{c} END, 6) AS {c}"
    for c in LINEITEM_NUM) + " FROM sp, mm")
def q_minmax_train_only(spark, sf_dir):
    """T5: min/max fitted on the training rows only, applied to both sides (no clipping)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINEITEM_NUM)
    # the split feeds both the fit and the output: cut lineage once (reliable checkpoint)
    sp = materialize(SP.train_test_split(li, ["l_orderkey", "l_linenumber"], None, 0.2, SEED))
    model = PR.fit_minmax(sp.where(F.col("split") == "train"), LINEITEM_NUM)
    scaled = PR.apply_minmax(sp, model)
    return scaled.select("l_orderkey", "l_linenumber", "split", *[r(c, 6).alias(c) for c in LINEITEM_NUM])


@register("minmax_params", _MM_SPLIT + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(mn_{c}, 6) AS min_value, round(mx_{c}, 6) AS max_value FROM mm"
    for c in LINEITEM_NUM))
def q_minmax_params(spark, sf_dir):
    """T5 parameters exposed as a table (feature, min, max) — J4 zip of names and vectors."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINEITEM_NUM)
    sp = SP.train_test_split(li, ["l_orderkey", "l_linenumber"], None, 0.2, SEED)
    model = PR.fit_minmax(sp.where(F.col("split") == "train"), LINEITEM_NUM)
    rows = [(c, round(mn, 6), round(mx, 6)) for c, mn, mx in model.table_rows()]
    return spark.createDataFrame(rows, "feature string, min_value double, max_value double")


# =============================================================================== T6 / T7
@register("kfold_ids", f"""WITH rk AS (SELECT o_orderkey,
  row_number() OVER (ORDER BY {T.md5_key_sql(SEED, 'o_orderkey')}, o_orderkey) - 1 AS r FROM orders),
p AS (SELECT count(*) AS n, count(*) // 5 AS q, count(*) % 5 AS rem FROM orders)
SELECT o_orderkey, CAST(CASE WHEN r < rem * (q + 1) THEN r // (q + 1)
                             ELSE rem + (r - rem * (q + 1)) // q END AS INTEGER) AS fold
FROM rk, p""")
def q_kfold_ids(spark, sf_dir):
    """Shuffled KFold ids; sizes differ by ≤ 1, the first folds larger."""
    o = T.orders(spark, sf_dir).select("o_orderkey")
    return SP.kfold_ids(o, "o_orderkey", 5, SEED)


@register("stratified_kfold_ids", f"""WITH c AS (SELECT o_orderstatus AS k, count(*) AS cnt FROM orders GROUP BY 1),
off AS (SELECT k, cnt, coalesce(sum(cnt) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM c),
fs AS (SELECT CAST(i AS BIGINT) AS f FROM range(0, 5) t(i)),
al AS (SELECT k, f, (CASE WHEN o + cnt <= f THEN 0 ELSE (o + cnt - f + 4) // 5 END)
                  - (CASE WHEN o <= f THEN 0 ELSE (o - f + 4) // 5 END) AS a FROM off, fs),
cu AS (SELECT k, f, a, sum(a) OVER (PARTITION BY k ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM al),
rk AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus
         ORDER BY {T.md5_key_sql(SEED, 'o_orderkey')}, o_orderkey) - 1 AS r FROM orders)
SELECT o_orderkey, o_orderstatus, CAST(cu.f AS INTEGER) AS fold
FROM rk JOIN cu ON rk.o_orderstatus = cu.k AND rk.r >= cu.hi - cu.a AND rk.r < cu.hi""")
def q_stratified_kfold_ids(spark, sf_dir):
    """StratifiedKFold per-class fold counts (round-robin allocation), rows in md5 order."""
    o = T.orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    return SP.stratified_kfold_ids(o, "o_orderkey", "o_orderstatus", 5, SEED)


# =============================================================================== P4 / P5
@register("threshold_class", "SELECT event_id, CASE WHEN value >= 50.0 THEN 1 ELSE 0 END AS value_class FROM events")
def q_threshold_class(spark, sf_dir):
    """Inclusive threshold to a 0/1 class."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "value")
    return PR.threshold_class(ev, "value", 50.0, "value_class").select("event_id", "value_class")


@register("target_map", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 1 "
                        "WHEN l_linestatus = 'O' THEN 0 END AS label FROM lineitem")
def q_target_map(spark, sf_dir):
    """P5: validated value map (any other value raises, listing the offenders)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    return PR.map_target(li, "l_linestatus", {"F": 1, "O": 0}, "label").drop("l_linestatus")


# =============================================================================== X5 / A22 / A23 / A28
THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
_SCORED_SQL = """sc AS (SELECT l.doc_id, l.quality AS label, d.n_chars / (d.n_chars + 2000.0) AS p
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def scored_labels(spark, sf_dir) -> DataFrame:
    """labels ⋈ documents (only doc_id, n_chars read); a monotone score of the length."""
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("label"),
        (F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0))).alias("probability"))


@register("threshold_sweep_metrics", f"""WITH {_SCORED_SQL},
th AS (SELECT CAST(t AS DOUBLE) AS threshold FROM (VALUES {', '.join(f'({t})' for t in THRESHOLDS)}) v(t)),
m AS (SELECT threshold,
        count(*) FILTER (WHERE label = 1 AND p >= threshold) AS tp,
        count(*) FILTER (WHERE label = 0 AND p >= threshold) AS fp,
        count(*) FILTER (WHERE label = 1 AND p < threshold) AS fn,
        count(*) FILTER (WHERE label = 0 AND p < threshold) AS tn
      FROM th, sc GROUP BY threshold)
SELECT threshold, tp, fp, fn, tn,
  round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
  (tp + tn) / (tp + tn + fp + fn) >= 0.76 AS meets_target
FROM m""")
def q_threshold_sweep_metrics(spark, sf_dir):
    """X5 sweep + A22 binary metrics (class 1, zero_division=0) + A28 target flag."""
    sw = ME.threshold_sweep(scored_labels(spark, sf_dir), THRESHOLDS)
    return sw.select("threshold", "tp", "fp", "fn", "tn", *[r(c, 6).alias(c) for c in
                                                             ("accuracy", "precision", "recall", "f1")],
                     ME.target_flag(F.col("accuracy"), 0.76).alias("meets_target"))


@register("confusion_matrix", f"""WITH {_SCORED_SQL}
SELECT 0 AS actual, count(*) FILTER (WHERE label = 0 AND p < 0.5) AS pred_0,
       count(*) FILTER (WHERE label = 0 AND p >= 0.5) AS pred_1 FROM sc
UNION ALL
SELECT 1 AS actual, count(*) FILTER (WHERE label = 1 AND p < 0.5) AS pred_0,
       count(*) FILTER (WHERE label = 1 AND p >= 0.5) AS pred_1 FROM sc""")
def q_confusion_matrix(spark, sf_dir):
    """2x2, rows actual, columns predicted, at the inclusive 0.5 threshold."""
    s = scored_labels(spark, sf_dir).withColumn("prediction", ME.predicted_class("probability", 0.5))
    return ME.confusion_matrix(s, "label", "prediction")


# =============================================================================== A21
@register("mae_baseline", f"""WITH tot AS (SELECT CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS n_test FROM orders),
rk AS (SELECT o_totalprice, row_number() OVER (ORDER BY {T.md5_key_sql(SEED, 'o_orderkey')}, o_orderkey) - 1 AS r FROM orders),
sp AS (SELECT o_totalprice, CASE WHEN r < n_test THEN 'test' ELSE 'train' END AS split FROM rk, tot),
st AS (SELECT avg(o_totalprice) AS mean_p, quantile_cont(o_totalprice, 0.5) AS median_p FROM sp WHERE split = 'train')
SELECT 'mean' AS predictor, split, count(*) AS n, round(avg(abs(mean_p - o_totalprice)), 2) AS mae FROM sp, st GROUP BY split
UNION ALL
SELECT 'median' AS predictor, split, count(*) AS n, round(avg(abs(median_p - o_totalprice)), 2) AS mae FROM sp, st GROUP BY split""")
def q_mae_baseline(spark, sf_dir):
    """Train and test MAE of constant (mean / median of train) predictors."""
    o = T.orders(spark, sf_dir).select("o_orderkey", "o_totalprice")
    sp = SP.train_test_split(o, "o_orderkey", None, 0.2, SEED).cache()
    train = sp.where(F.col("split") == "train")
    mean_p = train.agg(F.avg("o_totalprice")).first()[0]
    median_p = exact_quantiles(train, ["o_totalprice"], [0.5])["o_totalprice"][0]
    out = None
    for name, v in (("mean", mean_p), ("median", median_p)):
        m = ME.mae(sp.withColumn("prediction", F.lit(v)), "o_totalprice", "prediction", ["split"])
        m = m.select(F.lit(name).alias("predictor"), "split", "n", r("mae", 2).alias("mae"))
        out = m if out is None else out.unionByName(m)
    return out


# =============================================================================== A25
@register("cv_score_summary", f"""WITH rk AS (SELECT o_totalprice,
  row_number() OVER (ORDER BY {T.md5_key_sql(SEED, 'o_orderkey')}, o_orderkey) - 1 AS r FROM orders),
p AS (SELECT count(*) AS n, count(*) // 5 AS q, count(*) % 5 AS rem FROM orders),
f AS (SELECT o_totalprice, CASE WHEN r < rem * (q + 1) THEN r // (q + 1) ELSE rem + (r - rem * (q + 1)) // q END AS fold FROM rk, p),
fs AS (SELECT fold, sum(o_totalprice) AS s, count(*) AS c FROM f GROUP BY fold),
tt AS (SELECT sum(s) AS s, sum(c) AS c FROM fs),
mf AS (SELECT fold, (tt.s - fs.s) / (tt.c - fs.c) AS m FROM fs, tt),
sc AS (SELECT f.fold, avg(abs(f.o_totalprice - mf.m)) AS score FROM f JOIN mf ON f.fold = mf.fold GROUP BY f.fold)
SELECT round(avg(score), 2) AS mean_score, round(stddev_pop(score), 2) AS std_score, count(*) AS n_folds FROM sc""")
def q_cv_score_summary(spark, sf_dir):
    """T6 + E8-style refit per fold (mean predictor) + A25 mean / population std of fold MAE."""
    o = T.orders(spark, sf_dir).select("o_orderkey", "o_totalprice")
    f = SP.kfold_ids(o, "o_orderkey", 5, SEED).cache()
    per = {row["fold"]: (row["s"], row["c"]) for row in
           f.groupBy("fold").agg(F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("c")).collect()}
    tot_s, tot_c = sum(v[0] for v in per.values()), sum(v[1] for v in per.values())
    means = [(tot_s - per[k][0]) / (tot_c - per[k][1]) for k in range(5)]
    pred = F.element_at(F.array(*[F.lit(m) for m in means]), F.col("fold") + 1)
    scores = f.groupBy("fold").agg(F.avg(F.abs(F.col("o_totalprice") - pred)).alias("score"))
    s = ME.score_summary(scores, "score")
    return s.select(r("mean_score", 2).alias("mean_score"), r("std_score", 2).alias("std_score"), "n_folds")


# =============================================================================== A18–A20 / J1
_PROFILE_SQL = """pr AS (SELECT CAST(c_nationkey % 5 AS INTEGER) AS "Cluster", count(c_custkey) AS "Customers",
        avg(c_acctbal) AS ab, avg(CAST(c_nationkey AS DOUBLE)) AS an,
        100.0 * avg(CASE WHEN lower(c_mktsegment) = 'building' THEN 1.0 ELSE 0.0 END) AS bp
      FROM customer GROUP BY 1)"""


def customer_clusters(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "customer").withColumn("Cluster", (F.col("c_nationkey") % 5).cast("int"))


def customer_profile(spark, sf_dir) -> DataFrame:
    return CL.cluster_profile(customer_clusters(spark, sf_dir), "Cluster", "c_custkey",
                              {"Average_Balance": "c_acctbal", "Average_Nation": "c_nationkey"},
                              ("Building_Percent", "c_mktsegment", "BUILDING"))


@register("cluster_profile", f"""WITH {_PROFILE_SQL}
SELECT "Cluster", "Customers", round(ab, 4) AS "Average_Balance", round(an, 4) AS "Average_Nation",
       round(bp, 4) AS "Building_Percent" FROM pr""")
def q_cluster_profile(spark, sf_dir):
    """A18 profile per cluster + A19 case-insensitive share (%)."""
    p = customer_profile(spark, sf_dir)
    return p.select("Cluster", "Customers", *[r(c, 4).alias(c) for c in
                                              ("Average_Balance", "Average_Nation", "Building_Percent")])


@register("segment_names", f"""WITH {_PROFILE_SQL},
md AS (SELECT median(ab) AS mi, median(bp) AS ms FROM pr),
nm AS (SELECT "Cluster", CASE WHEN ab >= mi AND bp >= ms THEN '{CL.SEGMENT_HIGH_HIGH}'
                             WHEN ab >= mi AND bp < ms THEN '{CL.SEGMENT_HIGH_LOW}'
                             WHEN ab < mi AND bp >= ms THEN '{CL.SEGMENT_LOW_HIGH}'
                             ELSE '{CL.SEGMENT_LOW_LOW}' END AS "Segment" FROM pr, md)
SELECT c.c_custkey, CAST(c.c_nationkey % 5 AS INTEGER) AS "Cluster", nm."Segment"
FROM customer c LEFT JOIN nm ON CAST(c.c_nationkey % 5 AS INTEGER) = nm."Cluster\"""")
def q_segment_names(spark, sf_dir):
    """A20 rule-based names (median over clusters, >= on both) + J1 broadcast lookup per row."""
    names = CL.segment_names(customer_profile(spark, sf_dir), "Cluster", "Average_Balance", "Building_Percent")
    rows = customer_clusters(spark, sf_dir).select("c_custkey", "Cluster")
    return CL.attach_segments(rows, names, "Cluster").select("c_custkey", "Cluster", "Segment")


# =============================================================================== X4 / A24
_EMB_SQL = """x AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
sv AS (SELECT label, i, sum(v) AS s, count(*) AS c FROM (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM x) GROUP BY label, i),
cen AS (SELECT label, list(s / c ORDER BY i) AS ctr, list(s ORDER BY i) AS ssum FROM sv GROUP BY label)"""


def label_centres(emb: DataFrame):
    st = CL.cluster_stats(emb, "embedding", "label")
    return st


@register("assign_nearest_center", f"""WITH {_EMB_SQL},
d AS (SELECT x.vec_id, cen.label AS c,
        list_sum(list_transform(generate_series(1, len(x.x)), lambda j: (x.x[j] - cen.ctr[j]) * (x.x[j] - cen.ctr[j]))) AS dist
      FROM x, cen)
SELECT vec_id, arg_min(c, dist) AS cluster, round(min(dist), 4) AS sq_distance FROM d GROUP BY vec_id""")
def q_assign_nearest_center(spark, sf_dir):
    """Nearest-centre assignment (centres = per-label means) with squared distance (WCSS terms)."""
    emb = read_table(spark, sf_dir, "embeddings")
    st = label_centres(emb)
    out = CL.assign_nearest(emb, "embedding", st.centres, st.ids, "cluster", "sq_distance")
    return out.select("vec_id", "cluster", r("sq_distance", 4).alias("sq_distance"))


@register("wcss_by_cluster", f"""WITH {_EMB_SQL},
d AS (SELECT x.vec_id, x.label,
        list_sum(list_transform(generate_series(1, len(x.x)), lambda j: (x.x[j] - cen.ctr[j]) * (x.x[j] - cen.ctr[j]))) AS dist
      FROM x JOIN cen ON x.label = cen.label)
SELECT label AS cluster, count(*) AS n, round(sum(dist), 4) AS wcss FROM d GROUP BY label""")
def q_wcss_by_cluster(spark, sf_dir):
    """A24 WCSS per cluster of a given labelling (own-centre squared distances)."""
    emb = read_table(spark, sf_dir, "embeddings")
    st = label_centres(emb)
    cent = CL._literal_matrix(st.centres)
    idx = F.array(*[F.lit(i) for i in st.ids])
    own = F.element_at(cent, F.array_position(idx, F.col("label")).cast("int"))
    x = F.transform("embedding", lambda v: v.cast("double"))
    dist = F.aggregate(F.zip_with(x, own, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    return (emb.select(F.col("label").alias("cluster"), dist.alias("d")).groupBy("cluster")
            .agg(F.count(F.lit(1)).alias("n"), r(F.sum("d"), 4).alias("wcss")))


@register("silhouette", f"""WITH {_EMB_SQL},
xn AS (SELECT *, list_sum(list_transform(x, lambda v: v * v)) AS nx FROM x),
st AS (SELECT label, count(*) AS n, sum(nx) AS psi FROM xn GROUP BY label),
cs AS (SELECT st.label, st.n, st.psi, cen.ssum FROM st JOIN cen ON st.label = cen.label),
pd AS (SELECT xn.vec_id, xn.label AS own, cs.label AS c, cs.n,
              xn.nx * cs.n + cs.psi - 2.0 * list_sum(list_transform(generate_series(1, len(xn.x)), lambda j: xn.x[j] * cs.ssum[j])) AS sd
       FROM xn, cs),
ab AS (SELECT vec_id, own, max(CASE WHEN c = own THEN n END) AS n_own,
              max(CASE WHEN c = own THEN sd / (n - 1) END) AS a, min(CASE WHEN c <> own THEN sd / n END) AS b
       FROM pd GROUP BY vec_id, own),
s AS (SELECT own AS cluster, CASE WHEN n_own <= 1 THEN 0.0 WHEN a < b THEN 1 - a / b
                                  WHEN a > b THEN b / a - 1 ELSE 0.0 END AS s FROM ab)
SELECT cluster, count(*) AS n, round(avg(s), 6) AS silhouette FROM s GROUP BY cluster""")
def q_silhouette(spark, sf_dir):
    """A24 silhouette (squared Euclidean, linear-time), mean per cluster."""
    emb = read_table(spark, sf_dir, "embeddings")
    pts = CL.silhouette_points(emb, "embedding", "label")
    return (pts.groupBy(F.col("label").alias("cluster"))
            .agg(F.count(F.lit(1)).alias("n"), r(F.avg("silhouette"), 6).alias("silhouette")))


# =============================================================================== E1 / M1
@register("ols_fit", """SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS estimate FROM lineitem
UNION ALL
SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS estimate FROM lineitem""")
def q_ols_fit(spark, sf_dir):
    """E1 ordinary least squares (normal equations) + M1 coefficient table."""
    from tabwise.operators.models import fit_linear, coefficient_table
    li = read_table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    model = fit_linear(li, ["l_quantity"], "l_extendedprice")
    return coefficient_table(spark, model, ["l_quantity"]).select("term", r("estimate", 4).alias("estimate"))


# =============================================================================== L1 / L7
@register("head_tail", """SELECT * FROM (SELECT 'head' AS position, o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5)
UNION ALL
SELECT * FROM (SELECT 'tail' AS position, o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 5)""")
def q_head_tail(spark, sf_dir):
    """L1: first / last five rows in key order (top-k, not a global sort)."""
    o = T.orders(spark, sf_dir).select("o_orderkey", "o_totalprice")
    h = PF.head(o, "o_orderkey").select(F.lit("head").alias("position"), "o_orderkey", "o_totalprice")
    t = PF.tail(o, "o_orderkey").select(F.lit("tail").alias("position"), "o_orderkey", "o_totalprice")
    return h.unionByName(t)


@register("sample_rows", f"SELECT o_orderkey FROM orders ORDER BY {T.md5_key_sql(SEED, 'o_orderkey')}, o_orderkey LIMIT 10")
def q_sample_rows(spark, sf_dir):
    """Reproducible sample of exactly n rows (the limit is the operator)."""
    return PF.sample_rows(T.orders(spark, sf_dir).select("o_orderkey"), "o_orderkey", 10, SEED)


# =============================================================================== minimum slice (entry)
@register("orders_slice", f"""WITH {T.ORDERS_WITH_GAPS_SQL},
pm AS (SELECT o_orderpriority AS v FROM og WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1),
md AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM og),
im AS (SELECT o_orderkey, o_orderstatus, coalesce(o_totalprice, (SELECT m FROM md)) AS o_totalprice,
              coalesce(o_orderpriority, (SELECT v FROM pm)) AS o_orderpriority FROM og),
{_strat_quota_sql('im', 'o_orderstatus')},
rk AS (SELECT im.*, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {T.md5_key_sql(SEED, 'o_orderkey')}, o_orderkey) - 1 AS r FROM im),
sp AS (SELECT rk.*, CASE WHEN r < test_q THEN 'test' ELSE 'train' END AS split
       FROM rk JOIN quota ON rk.o_orderstatus IS NOT DISTINCT FROM quota.k)
SELECT split, o_orderstatus, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share,
       round(avg(o_totalprice), 2) AS mean_totalprice,
       round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END), 6) AS urgent_share
FROM sp GROUP BY split, o_orderstatus""")
def q_orders_slice(spark, sf_dir):
    """Minimum end-to-end slice: impute → one-hot → stratified split → per split and class report."""
    return orders_slice(T.orders_with_gaps(spark, sf_dir))


def orders_slice(og: DataFrame) -> DataFrame:
    og = og.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    imputed, _ = PR.impute(og, mode_cols=["o_orderpriority"], median_cols=["o_totalprice"])
    # every row stays: a missing status is its own stratum
    encoded, _ = PR.one_hot(imputed, ["o_orderpriority"])
    sp = SP.train_test_split(encoded, "o_orderkey", "o_orderstatus", 0.2, SEED)
    g = sp.groupBy("split", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_totalprice"),
        F.avg("`o_orderpriority_1-URGENT`").alias("urgent_share"))
    totals = sp.groupBy("split").agg(F.count(F.lit(1)).alias("split_n"))
    return (g.join(F.broadcast(totals), "split")  # two rows: train / test
            .select("split", "o_orderstatus", "n", r(F.col("n") / F.col("split_n"), 6).alias("share"),
                    r("mean_totalprice", 2).alias("mean_totalprice"), r("urgent_share", 6).alias("urgent_share")))


# =============================================================================== J2 / P13 / L8 / S6
@register("null_report_before_after", f"""WITH {T.ORDERS_WITH_GAPS_SQL},
b AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n FROM og" for c in _OG_COLS)})
SELECT column_name, n AS nulls_before,
       CASE WHEN column_name IN ('o_orderstatus', 'o_orderpriority', 'o_totalprice') THEN 0 ELSE n END AS nulls_after
FROM b""")
def q_null_report_before_after(spark, sf_dir):
    """Per column NULLs before and after imputation (full outer join on the column name)."""
    og = T.orders_with_gaps(spark, sf_dir)
    imputed, _ = PR.impute(og, mode_cols=["o_orderstatus", "o_orderpriority"], median_cols=["o_totalprice"])
    before = PF.null_report(og).select(F.col("column").alias("column_name"), F.col("null_count").alias("nulls_before"))
    after = PF.null_report(imputed).select(F.col("column").alias("column_name"), F.col("null_count").alias("nulls_after"))
    return before.join(after, "column_name", "full")


@register("first_test_row", f"""WITH tot AS (SELECT CAST(ceil(CAST(0.25 AS DOUBLE) * count(*)) AS BIGINT) AS n_test FROM customer),
rk AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY {T.md5_key_sql(7, 'c_custkey')}, c_custkey) - 1 AS r FROM customer)
SELECT c_custkey, c_acctbal FROM rk, tot WHERE r < n_test ORDER BY c_custkey LIMIT 1""")
def q_first_test_row(spark, sf_dir):
    """The first test row in id order (default record and its actual value)."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    sp = SP.train_test_split(c, "c_custkey", None, 0.25, 7)
    return PF.head(sp.where(F.col("split") == "test"), "c_custkey", 1).select("c_custkey", "c_acctbal")


_CODED = ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
_CODED_SQL = "WITH c AS (" + " UNION ALL ".join(
    f"SELECT {k} AS k, '{c}' AS name, {c if k < 2 else 'NULL'} AS whole, CAST({c} AS VARCHAR) AS category, count(*) AS n FROM lineitem "
    f"WHERE {c} IS NOT NULL GROUP BY {c}" for k, c in enumerate(_CODED)) + """),
placed AS (SELECT *, row_number() OVER (ORDER BY k, whole, category) - 1 AS place, sum(n) OVER (PARTITION BY k) AS of_column FROM c)
"""


@register("category_dictionary", _CODED_SQL + """SELECT name, category, place, n AS rows_at_fit, n * 1024 > of_column AS hot FROM placed""")
def q_category_dictionary(spark, sf_dir):
    """The categories of two id columns and two flags as one table with their vector places."""
    words = EN.fit_categories(read_table(spark, sf_dir, "lineitem"), _CODED)
    names = spark.createDataFrame(list(enumerate(_CODED)), "k int, name string")
    return words.entries.join(F.broadcast(names), "k").select("name", "category", "place", F.col("n").alias("rows_at_fit"), "hot")


@register("sparse_one_hot", _CODED_SQL + """SELECT 0 AS place, 'l_discount' AS feature, count(*) FILTER (WHERE l_discount <> 0) AS nonzero FROM lineitem
UNION ALL SELECT place + 1, name || '_' || category, n FROM placed""")
def q_sparse_one_hot(spark, sf_dir):
    """Every line item as a sparse vector of a number and its categories; how many vectors have each feature."""
    items = read_table(spark, sf_dir, "lineitem").select("l_discount", *_CODED)
    words = EN.fit_categories(items, _CODED)
    vectors = EN.sparse_one_hot(items, words, ["l_discount"])
    counts = vectors.agg(vector_to_array(Summarizer.numNonZeros(F.col("features"))).alias("n")).select(F.posexplode("n").alias("place", "nonzero"))
    return (counts.join(EN.feature_names(words, ["l_discount"]), "place")
            .select(F.col("place").cast("long").alias("place"), "feature", F.col("nonzero").cast("long").alias("nonzero")))


@register("processed_table_sink", ORACLE_SQL["one_hot"])
def q_processed_table_sink(spark, sf_dir):
    """S6 + S1: the encoded table written as headered CSV, read back through validated ingest."""
    import uuid

    from tabwise.session import ensure_checkpoint_dir
    from tabwise.sources.csv import read_csv
    from tabwise.sources.sinks import write_table
    out = q_one_hot(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}"
    write_table(out, path, fmt="csv")
    return read_csv(spark, path, schema=out.schema)


@register("schema_listing", """SELECT c.column_name, c.non_null,
  CASE t.kind WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
       WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE lower(t.kind) END AS dtype
FROM (UNPIVOT (SELECT count(COLUMNS(*)) AS "\\0" FROM lineitem) ON COLUMNS(*) INTO NAME column_name VALUE non_null) c
JOIN (UNPIVOT (SELECT any_value(typeof(COLUMNS(*))) AS "\\0" FROM lineitem) ON COLUMNS(*) INTO NAME column_name VALUE kind) t USING (column_name)""")
def q_schema_listing(spark, sf_dir):
    """Column, Spark type and non-null count of lineitem (one pass)."""
    return PF.schema_listing(read_table(spark, sf_dir, "lineitem")).withColumnRenamed("column", "column_name")


@register("class_names", """SELECT CASE WHEN o_orderstatus = 'F' THEN 'Fulfilled' WHEN o_orderstatus = 'O' THEN 'Open'
  ELSE o_orderstatus END AS status_name, count(*) AS n FROM orders GROUP BY 1""")
def q_class_names(spark, sf_dir):
    """P10: codes relabelled to display names before counting (unmapped codes kept)."""
    o = PR.relabel(T.orders(spark, sf_dir), "o_orderstatus", {"F": "Fulfilled", "O": "Open"}, "status_name")
    return o.groupBy("status_name").agg(F.count(F.lit(1)).alias("n"))


@register("corr_spearman_gaps", f"""WITH {T.ORDERS_WITH_GAPS_SQL},
p AS (SELECT o_totalprice AS a, CAST(o_custkey AS DOUBLE) AS b FROM og WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL),
rk AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
              rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM p)
SELECT 'o_totalprice' AS col_a, 'o_custkey' AS col_b, round(corr(ra, rb), 6) AS corr FROM rk
UNION ALL SELECT 'o_custkey', 'o_totalprice', round(corr(ra, rb), 6) FROM rk
UNION ALL SELECT 'o_totalprice', 'o_totalprice', CAST(1.0 AS DOUBLE)
UNION ALL SELECT 'o_custkey', 'o_custkey', CAST(1.0 AS DOUBLE)""")
def q_corr_spearman_gaps(spark, sf_dir):
    """A13 with NULLs: each pair ranked on its own complete rows (pandas semantics)."""
    m = CO.spearman_matrix(T.orders_with_gaps(spark, sf_dir), ["o_totalprice", "o_custkey"])
    return m.select("col_a", "col_b", r("corr", 6).alias("corr"))


@register("kfold_ids_unshuffled", """WITH rk AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders),
p AS (SELECT count(*) // 5 AS q, count(*) % 5 AS rem FROM orders)
SELECT o_orderkey, CAST(CASE WHEN r < rem * (q + 1) THEN r // (q + 1)
                             ELSE rem + (r - rem * (q + 1)) // q END AS INTEGER) AS fold
FROM rk, p""")
def q_kfold_ids_unshuffled(spark, sf_dir):
    """T6 unshuffled (the notebooks' KFold): contiguous folds in id order, exact global rank
    from range partitions + per-partition offsets."""
    return SP.kfold_ids(T.orders(spark, sf_dir).select("o_orderkey"), "o_orderkey", 5, shuffle=False)


@register("ols_two_features", """WITH s AS (SELECT covar_pop(l_quantity, l_quantity) AS sxx, covar_pop(l_discount, l_discount) AS syy,
  covar_pop(l_quantity, l_discount) AS sxy, covar_pop(l_quantity, l_extendedprice) AS sxt,
  covar_pop(l_discount, l_extendedprice) AS syt, avg(l_quantity) AS mx, avg(l_discount) AS my,
  avg(l_extendedprice) AS mt FROM lineitem),
b AS (SELECT (syy * sxt - sxy * syt) / (sxx * syy - sxy * sxy) AS b1,
             (sxx * syt - sxy * sxt) / (sxx * syy - sxy * sxy) AS b2, mx, my, mt FROM s)
SELECT 'intercept' AS term, round(mt - b1 * mx - b2 * my, 4) AS estimate FROM b
UNION ALL SELECT 'l_quantity', round(b1, 4) FROM b
UNION ALL SELECT 'l_discount', round(b2, 4) FROM b""")
def q_ols_two_features(spark, sf_dir):
    """E1 with two features + M1: normal-equation OLS checked against the closed-form 2×2 solve."""
    from tabwise.operators.models import coefficient_table, fit_linear
    li = read_table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    model = fit_linear(li, ["l_quantity", "l_discount"], "l_extendedprice")
    return coefficient_table(spark, model).select("term", r("estimate", 4).alias("estimate"))
