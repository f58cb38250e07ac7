import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.errors import PipelineError
from tabwise.operators import prep as PR
from tabwise.operators import profile as PF


def test_impute_mode_and_even_median(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", None), ("a", 3.0), ("b", 10.0), (None, 20.0)],
                               "c string, x double")
    out, stats = PR.impute(df, ["c"], ["x"])
    assert stats.values == {"c": "a", "x": 6.5}
    rows = out.collect()
    assert [r.c for r in rows] == ["b", "a", "a", "b", "a"]
    assert [r.x for r in rows] == [1.0, 6.5, 3.0, 10.0, 20.0]


def test_impute_all_null_column_errors(spark):
    df = spark.createDataFrame([(None,), (None,)], "c string")
    with pytest.raises(PipelineError):
        PR.impute(df, ["c"], [])


def test_one_hot_order_nulls_and_unseen(spark):
    df = spark.createDataFrame([(1, "y", 5), (2, None, 6), (3, "x", 7)], "id int, c string, z int")
    out, model = PR.one_hot(df, ["c"])
    assert out.columns == ["id", "z", "c_x", "c_y"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 5, 0, 1), (2, 6, 0, 0), (3, 7, 1, 0)]
    fresh = spark.createDataFrame([(9, "new", 1)], "id int, c string, z int")
    assert tuple(PR.apply_one_hot(fresh, model).first()) == (9, 1, 0, 0)
    # each group of dummies sums to 1 for a known category, 0 otherwise
    assert out.select((F.col("c_x") + F.col("c_y")).alias("s")).distinct().count() == 2


def test_one_hot_integer_categories_keep_integer_names(spark):
    df = spark.createDataFrame([(1, 4), (2, 1)], "id int, rating long")
    out, _ = PR.one_hot(df, ["rating"])
    assert out.columns == ["id", "rating_1", "rating_4"]


def test_minmax_constant_column_and_no_clipping(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    model = PR.fit_minmax(train, ["a", "b"])
    test = spark.createDataFrame([(5.0, 7.0)], "a double, b double")
    row = PR.apply_minmax(test, model).first()
    assert row.a == 2.0 and row.b == 2.0  # (5-1)/2 and constant → x - min
    tr = PR.apply_minmax(train, model).agg(F.min("a"), F.max("a")).first()
    assert (tr[0], tr[1]) == (0.0, 1.0)


def test_map_target_rejects_other_values(spark):
    df = spark.createDataFrame([("Y",), ("N",), ("maybe",), (None,)], "t string")
    with pytest.raises(PipelineError) as e:
        PR.map_target(df, "t", {"Y": 1, "N": 0})
    assert "maybe" in str(e.value)


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.8,), (0.79,), (None,)], "p double")
    assert [r.p for r in PR.threshold_class(df, "p", 0.8).collect()] == [1, 0, 0]


def test_histogram_edges_and_last_bin(spark):
    vals = [0.0, 1.0, 2.0, 3.0, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    h = PF.histogram(df, "x", 5).collect()
    counts = [r["count"] for r in h]
    assert counts == list(np.histogram(vals, bins=5)[0])
    assert sum(counts) == 5 and h[-1]["bin_hi"] == 10.0


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    h = PF.histogram(df, "x", 3).collect()
    assert [r["count"] for r in h] == [2, 0, 0]


def test_density_matches_numpy(spark):
    rng = np.random.default_rng(0)
    vals = rng.normal(size=400)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    d = PF.density_grid(df, "x", 11).orderBy("grid_index").collect()
    h = vals.std(ddof=1) * len(vals) ** -0.2
    grid = np.linspace(vals.min(), vals.max(), 11)
    want = [np.mean(np.exp(-0.5 * ((g - vals) / h) ** 2)) / (h * math.sqrt(2 * math.pi)) for g in grid]
    assert np.allclose([r.density for r in d], want, rtol=1e-9)


def test_null_report_and_describe(spark):
    df = spark.createDataFrame([(1.0, None), (None, "a"), (float("nan"), "b")], "x double, s string")
    rep = [(r["column"], r["null_count"]) for r in PF.null_report(df).collect()]
    assert rep == [("x", 2), ("s", 1)]
    d = PF.describe_numeric(spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double"), ["v"]).first()
    assert (d["count"], d["mean"], d["min"], d["p25"], d["p50"], d["p75"], d["max"]) == (10, 5.5, 1.0, 3.25, 5.5, 7.75, 10.0)
    assert abs(d["std"] - np.std(np.arange(1, 11), ddof=1)) < 1e-12


def test_value_counts_and_shares(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "c string")
    assert [(r.c, r["count"]) for r in PF.value_counts(df, "c").collect()] == [("b", 2), ("a", 1)]
    shares = {r.c: r.share for r in PF.class_shares(df, "c").collect()}
    assert shares == {"b": 2 / 3, "a": 1 / 3}


def test_sample_rows_exact_count(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert PF.sample_rows(df, "k", 7).count() == 7


def test_relabel_keeps_unmapped_codes(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "y int")
    out = [r.name for r in PR.relabel(df, "y", {0: "No", 1: "Yes"}, "name").orderBy("y").collect()]
    assert out == ["No", "Yes", "2"]


def test_schema_listing_counts_non_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "a int, b string")
    got = {r["column"]: (r.dtype, r.non_null) for r in PF.schema_listing(df).collect()}
    assert got == {"a": ("int", 2), "b": ("string", 1)}


def test_spearman_pairwise_complete_with_nulls(spark):
    import pandas as pd
    rows = [(1.0, 2.0, 5.0), (2.0, None, 3.0), (3.0, 1.0, None), (4.0, 4.0, 1.0), (5.0, 3.0, 2.0), (2.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    from tabwise.operators.correlation import spearman_matrix
    got = {(r.col_a, r.col_b): r.corr for r in spearman_matrix(df, ["a", "b", "c"]).collect()}
    want = pd.DataFrame(rows, columns=["a", "b", "c"]).corr(method="spearman")
    for (x, y), v in got.items():
        assert abs(v - want.loc[x, y]) < 1e-12


def test_nan_is_missing_in_quantiles_and_describe(spark):
    from tabwise.operators.quantiles import exact_quantiles
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5])["x"] == [2.0]
    d = PF.describe_numeric(df, ["x"]).first()
    assert (d["count"], d["mean"], d["max"]) == (2, 2.0, 3.0)


def test_average_ranks_with_heavy_ties_across_partitions(spark):
    import pandas as pd
    from tabwise.operators.correlation import average_ranks
    vals = [5.0] * 700 + [float(i % 37) for i in range(600)] + [None] * 3
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, x double").repartition(7)
    got = {r.id: r.rk for r in average_ranks(df, "x", "rk").collect()}
    want = pd.Series(vals).rank(method="average")
    for i, v in enumerate(vals):
        if v is None:
            assert got[i] is None
        else:
            assert got[i] == want[i]


def test_describe_all_mixes_types_and_counts_nan_as_missing(spark):
    df = spark.createDataFrame([("a", 1.0, 3, True), ("b", float("nan"), 5, False), ("a", 3.0, None, True)],
                               "t string, x double, n int, f boolean")
    rows = {r["column"]: r for r in PF.describe_all(df).collect()}
    assert (rows["t"]["count"], rows["t"]["unique"], rows["t"]["top"], rows["t"]["freq"], rows["t"]["mean"]) == (3, 2, "a", 2, None)
    assert (rows["f"]["top"], rows["f"]["freq"]) == ("true", 2)
    assert (rows["x"]["count"], rows["x"]["mean"], rows["x"]["p50"], rows["x"]["unique"]) == (2, 2.0, 2.0, None)
    assert (rows["n"]["min"], rows["n"]["max"]) == (3.0, 5.0)
    assert PF.describe_all(df.select("t")).columns == PF.describe_all(df.select("n")).columns


def test_scatter_matrix_matches_brute_force_with_missing_values(spark):
    rows = [(0.0, 0.0, 5.0), (1.0, 10.0, 5.0), (2.0, None, 5.0), (4.0, 10.0, None), (float("nan"), 3.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r.x_column, r.y_column, r.x_bin, r.y_bin): r["count"] for r in PF.scatter_matrix(df, ["a", "b", "c"], 4).collect()}

    def place(c, v):
        seen = [r[c] for r in rows if r[c] is not None and not math.isnan(r[c])]
        if v is None or math.isnan(v):
            return None
        lo, hi = min(seen), max(seen)
        return 1 if hi == lo else min(int((v - lo) * 4 / (hi - lo)) + 1, 4)

    want = {}
    for r in rows:
        for i in range(3):
            for j in range(i, 3):
                cell = ("abc"[i], "abc"[j], place(i, r[i]), place(j, r[j]))
                if None not in cell:
                    want[cell] = want.get(cell, 0) + 1
    assert got == want
    assert PF.scatter_matrix(df.limit(0), ["a", "b"], 4).count() == 0


def test_density_leaves_nan_out(spark):
    values = [1.0, 2.0, 4.0, 8.0]
    clean = spark.createDataFrame([(v,) for v in values], "x double")
    dirty = spark.createDataFrame([(v,) for v in values + [float("nan"), None]], "x double")
    assert [tuple(r) for r in PF.density_grid(dirty, "x", 7).orderBy("grid_index").collect()] == \
        [tuple(r) for r in PF.density_grid(clean, "x", 7).orderBy("grid_index").collect()]
