import numpy as np
import pytest

from tabwise.operators.quantiles import approx_quantiles, exact_quantiles, mode_row, modes


def test_exact_quantiles_match_numpy_with_ties_and_nulls(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=3001), np.full(500, 0.25), rng.integers(0, 5, 400)])
    rows = [(float(v),) for v in vals] + [(None,)] * 37
    df = spark.createDataFrame(rows, "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, ["x"], probs, accuracy=50, close=16)  # coarse sketches, small brackets: several passes
    want = np.quantile(vals, probs)  # linear interpolation
    assert np.allclose(got["x"], want, rtol=0, atol=1e-12)


def test_even_count_median_is_mean_of_middle_pair(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (100.0,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5])["x"][0] == 6.0


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(7.0, None), (7.0, None)], "a double, b double")
    out = exact_quantiles(df, ["a", "b"], [0.5])
    assert out == {"a": [7.0], "b": [None]}


def test_hot_value_third_of_rows(spark):
    vals = [1.0] * 3000 + [float(i) for i in range(6000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, ["x"], [0.25, 0.5, 0.75])["x"]
    assert np.allclose(got, np.quantile(vals, [0.25, 0.5, 0.75]))


def test_modes_ties_go_to_smallest_value(spark):
    df = spark.createDataFrame([("b", 3), ("a", 3), ("b", 2), ("a", 2), ("c", None), (None, 10)],
                               "s string, n int")
    m = modes(df, ["s", "n"])
    assert m["s"] == ("a", 2)
    assert m["n"] == (2, 2)
    assert mode_row(df, "s") == ("a", 2)


def test_modes_numeric_ties_are_numeric_not_lexicographic(spark):
    df = spark.createDataFrame([(10,), (10,), (9,), (9,)], "n int")
    assert modes(df, ["n"])["n"] == (9, 2)


def test_approx_quantiles_close(spark):
    vals = list(range(10001))
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = approx_quantiles(df, ["x"], [0.5])["x"][0]
    assert abs(got - 5000) <= 2


@pytest.mark.parametrize("accuracy, close, most", [(10_000, 1 << 22, 2), (10_000, 64, 3)])
def test_few_scans_whatever_the_spread(spark, accuracy, close, most):
    rng = np.random.default_rng(8)
    tiny = np.exp(rng.uniform(np.log(1e-100), np.log(1e100), 3000))
    columns = {"a": rng.lognormal(0, 8, 3000), "b": tiny, "c": np.concatenate([[-np.inf] * 40, rng.normal(size=2900), [np.inf] * 60]),
               "d": np.where(rng.random(3000) < 0.4, 5.0, rng.normal(size=3000))}
    df = spark.createDataFrame(list(zip(*(v.tolist() for v in columns.values()))), ", ".join(f"{c} double" for c in columns))
    probs, scans = [0.0, 0.25, 0.5, 0.9, 1.0], []
    got = exact_quantiles(df, list(columns), probs, accuracy=accuracy, close=close, scans=scans)
    for c, values in columns.items():
        low, high = (np.quantile(values, probs, method=m) for m in ("lower", "higher"))     # NumPy's own mix of equal infinities is NaN
        share = np.array([(len(values) - 1) * p % 1 for p in probs])
        with np.errstate(invalid="ignore"):
            assert np.allclose(got[c], np.where(low == high, low, low + share * (high - low)), rtol=1e-9, atol=0)
    assert len(scans) <= most


def test_integers_above_two_to_the_53(spark):
    base = 1 << 60
    df = spark.createDataFrame([(base + k,) for k in (0, 1, 1, 2, 3, 4, 5)], "n long")
    assert exact_quantiles(df, ["n"], [0.5, 1.0])["n"] == [base + 2, base + 5]
    assert exact_quantiles(df, ["n"], [0.5], accuracy=50, close=2)["n"] == [base + 2]
    assert modes(df, ["n"])["n"] == (base + 1, 2)
    assert exact_quantiles(df.where("false"), ["n"], [0.5])["n"] == [None]
