"""Inputs that the driver tables never show: constant columns, NaN, type suffixes, nulls at scoring time."""

import math

import pytest
from pyspark.sql import functions as F

from tabwise.errors import PipelineError
from tabwise.functions.columns import text_to_double
from tabwise.operators import prep as PR, profile as PF
from tabwise.operators.correlation import corr_with_target, pearson_matrix, spearman_matrix
from tabwise.operators.scoring import encode_raw
from tabwise.sources.models_io import Bundle
from tabwise.sources.validate import coerce_and_reject


def test_constant_and_nan_columns_in_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.1), (3.0, 5.0, 5.9), (float("nan"), 5.0, 7.0)], "x double, k double, y double")
    for matrix in (pearson_matrix(df, ["x", "k", "y"]), spearman_matrix(df, ["x", "k", "y"])):
        got = {(r["col_a"], r["col_b"]): r["corr"] for r in matrix.collect()}
        assert got["k", "k"] is None and got["x", "k"] is None and got["x", "x"] == 1.0 and got["x", "y"] > 0.99
    got = {r["column"]: r["corr"] for r in corr_with_target(df, "y", ["x", "k", "y"]).collect()}
    assert got["k"] is None and math.isclose(got["x"], 0.9996, abs_tol=1e-3)


def test_java_number_suffixes_are_text(spark):
    df = spark.createDataFrame([("1.5",), (" -2e3 ",), ("5f",), ("7d",), ("x",), (".5",)], "v string")
    assert [r[0] for r in df.select(text_to_double(F.col("v"))).collect()] == [1.5, -2000.0, None, None, None, 0.5]
    with pytest.raises(PipelineError):
        coerce_and_reject(df, ["v"])


def test_scoring_fills_with_training_defaults(spark):
    bundle = Bundle("classification", ["x", "c_a", "c_b", "flag_True"],
                    {"defaults": {"x": 7.0, "c": "b", "flag": True}, "categories": {"c": ["a", "b"], "flag": [False, True]}}, None)
    df = spark.createDataFrame([(None, None, None), (1.0, "a", False)], "x double, c string, flag boolean")
    got = [tuple(r[c] for c in bundle.features) for r in encode_raw(df, bundle).collect()]
    assert got == [(7.0, 0.0, 1.0, 1.0), (1.0, 1.0, 0.0, 0.0)]


def test_nan_is_missing_everywhere(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 3.0), (4, None)], "id int, x double")
    assert [r["x"] for r in PR.impute(df, median_cols=["x"])[0].orderBy("id").collect()] == [1.0, 2.0, 3.0, 2.0]
    assert sorted((r["x"], r["count"]) for r in PF.value_counts(df, "x").collect()) == [(1.0, 1), (3.0, 1)]
    assert [r["count"] for r in PF.histogram(df, "x", 2).collect()] == [1, 1]
    assert {r["column"]: r["non_null"] for r in PF.schema_listing(df).collect()} == {"id": 4, "x": 2}


def test_dotted_category_names_scale(spark):
    df = spark.createDataFrame([("B.Sc", 1.0), ("M.Sc", 2.0)], "degree string, x double")
    encoded, _ = PR.one_hot(df, ["degree"])
    scaled = PR.apply_minmax(encoded, PR.fit_minmax(encoded, encoded.columns))
    assert sorted(map(tuple, scaled.collect())) == [(0.0, 1.0, 0.0), (1.0, 0.0, 1.0)]
