"""Randomised property tests (hypothesis): exact quantiles and exact split sizes."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabwise.operators.quantiles import exact_quantiles
from tabwise.operators.split import train_quotas, train_test_split

SETTINGS = dict(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@settings(**SETTINGS)
@given(st.lists(st.one_of(st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
                min_size=1, max_size=300),
       st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_exact_quantiles_equal_numpy(spark, values, probs):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, ["x"], probs, accuracy=50, close=8)["x"]
    want = np.quantile(np.array(values), probs)
    assert np.allclose(got, want, rtol=1e-12, atol=1e-9)


@settings(**SETTINGS)
@given(st.lists(st.integers(2, 60), min_size=1, max_size=5), st.sampled_from([0.1, 0.2, 0.25, 0.5]))
def test_stratified_split_sizes_and_quotas(spark, sizes, test_size):
    rows, i = [], 0
    for label, n in enumerate(sizes):
        for _ in range(n):
            rows.append((i, label))
            i += 1
    n = len(rows)
    df = spark.createDataFrame(rows, "id long, y int")
    n_test = math.ceil(test_size * n)
    if n_test >= n:
        return
    sp = train_test_split(df, "id", "y", test_size, 5)
    got = {(r.split, r.y): r["count"] for r in sp.groupBy("split", "y").count().collect()}
    quotas = train_quotas(list(enumerate(sizes)), n - n_test)
    assert sum(v for (s, _), v in got.items() if s == "test") == n_test
    for label, size in enumerate(sizes):
        assert got.get(("train", label), 0) == quotas[label]
        assert got.get(("train", label), 0) + got.get(("test", label), 0) == size
