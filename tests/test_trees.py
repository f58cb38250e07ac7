import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.errors import PipelineError
from tabwise.operators import trees as TR
from tests.conftest import SF_SMALL


def _cost(y, criterion):
    if len(y) == 0:
        return 0.0
    if criterion in ("squared_error", "friedman_mse"):
        return ((y - y.mean()) ** 2).sum()
    if criterion == "absolute_error":
        return np.abs(y - np.median(y)).sum()
    if criterion == "poisson":
        return -y.sum() * np.log(y.mean())
    p = np.unique(y, return_counts=True)[1] / len(y)
    return len(y) * (1 - (p ** 2).sum() if criterion == "gini" else -(p * np.log2(p)).sum())


def _grow(x, y, criterion, depth, min_split):
    """Plain recursive tree: (feature, threshold, left, right), or the leaf's value."""
    if criterion in TR.CLASS_CRITERIA:
        leaf = float(np.unique(y)[np.argmax(np.unique(y, return_counts=True)[1])])
    else:
        leaf = float(np.median(y)) if criterion == "absolute_error" else float(y.mean())
    if depth == 0 or len(y) < min_split or len(np.unique(y)) == 1:
        return leaf
    best, whole = None, _cost(y, criterion)
    scale = y.sum() if criterion == "poisson" else whole
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= t
            if criterion == "poisson" and (y[low].sum() == 0 or y[~low].sum() == 0):
                continue
            gain = round((whole - _cost(y[low], criterion) - _cost(y[~low], criterion)) / scale, 9)
            if best is None or gain > best[0]:
                best = (gain, f, t, low)
    if best is None:
        return leaf
    _, f, t, low = best
    return (f, t, _grow(x[low], y[low], criterion, depth - 1, min_split), _grow(x[~low], y[~low], criterion, depth - 1, min_split))


def _nested(model, node=0):
    rows = {r[1]: r for r in model.nodes if r[0] == 0}
    _, _, feature, threshold, left, right, _, _, values = rows[node]
    if feature < 0:
        return values[0] if model.classes is None else model.classes[int(np.argmax(values))]
    return (feature, threshold, _nested(model, left), _nested(model, right))


def _same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if not isinstance(a, tuple):
        return abs(a - b) < 1e-9
    return a[0] == b[0] and abs(a[1] - b[1]) < 1e-12 and _same(a[2], b[2]) and _same(a[3], b[3])


def _data(n=200, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 40, n), rng.integers(0, 12, n), rng.normal(size=n).round(1)]).astype(float)
    y = np.round(np.abs(x[:, 0] - 20) + 3 * (x[:, 1] > 6) + rng.exponential(4, n))
    return x, y


def _frame(spark, x, y):
    return spark.createDataFrame([(int(i), *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "id long, a double, b double, `c.d` double, y double")


@pytest.mark.parametrize("criterion, depth, min_split", [
    ("squared_error", 4, 2), ("friedman_mse", 3, 30), ("poisson", 4, 10), ("absolute_error", 4, 2),
    ("absolute_error", None, 25), ("gini", 4, 15), ("entropy", 3, 2), ("log_loss", 2, 60)])
def test_tree_equals_brute_force(spark, criterion, depth, min_split):
    x, y = _data()
    if criterion in TR.CLASS_CRITERIA:
        y = np.minimum(y // 6, 2)
    model = TR.fit_trees(_frame(spark, x, y).repartition(3), ["a", "b", "c.d"], "y", criterion, max_depth=depth,
                         min_samples_split=min_split, max_bins=128)
    want = _grow(x, y, criterion, 99 if depth is None else depth, min_split)
    assert _same(_nested(model), want)


def test_same_forest_for_any_partitions_few_statistics_a_job_and_after_reload(spark, monkeypatch):
    x, y = _data(300, 1)
    df = _frame(spark, x, y)
    args = (["a", "b", "c.d"], "y", "poisson", 5, 5, 8, 2, ["id"])
    one = TR.fit_trees(df.coalesce(1), *args)
    monkeypatch.setattr(TR, "CELLS", 1)                  # one node a job
    many = TR.fit_trees(df.repartition(7), *args[:4], 2, *args[5:])
    top = [[(t, n, f, None if f < 0 else cut, rows) for t, n, f, cut, _, _, rows, *_ in m.nodes if n < 3] for m in (one, many)]
    assert top[0] == top[1]
    assert 1 + max(r[0] for r in one.nodes) == 5 and len({r[6] for r in one.nodes if r[1] == 0}) > 1     # other samples
    again = TR.TreeTable.from_table(one.table(spark), one.features, one.label, one.classes, one.params)
    want = {r.id: r.prediction for r in one.transform(df).collect()}
    assert {r.id: r.prediction for r in again.transform(df.repartition(4)).collect()} == want
    error = np.mean([abs(want[i] - t) for i, t in enumerate(y)])
    assert error < 0.7 * np.abs(y - y.mean()).mean()
    assert abs(sum(one.importances()) - 1) < 1e-9


def test_many_values_take_quantile_cuts(spark):
    rng = np.random.default_rng(5)
    x = rng.lognormal(0, 3, 2000)
    df = spark.createDataFrame([(float(v), float(np.log(v))) for v in x], "a double, y double")
    for criterion in ("squared_error", "absolute_error"):
        model = TR.fit_trees(df, ["a"], "y", criterion, max_depth=4, max_bins=32, label_bins=64)
        got = model.transform(df).select(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
        assert got < 0.5         # 16 leaves of a spread of 3


def test_one_row_constant_columns_missing_values_and_wrong_labels(spark):
    one = spark.createDataFrame([(1.0, 5.0)], "a double, y double")
    assert TR.fit_trees(one, ["a"], "y", "absolute_error").transform(one).first().prediction == 5.0
    same = spark.createDataFrame([(1.0, 5.0), (1.0, 7.0), (1.0, 9.0)], "a double, y double")
    model = TR.fit_trees(same, ["a"], "y", "squared_error")
    assert len(model.nodes) == 1 and model.transform(same.drop("a")).first().prediction == 7.0
    assert model.transform(same.limit(0)).count() == 0
    for bad in ([(None, 1.0)], [(1.0, None)], [(float("nan"), 1.0)], [(1.0, -1.0)], []):
        with pytest.raises(PipelineError):
            TR.fit_trees(spark.createDataFrame(bad, "a double, y double"), ["a"], "y", "poisson")
    with pytest.raises(PipelineError):
        TR.fit_trees(one, ["a"], "y", "gain")
    with pytest.raises(PipelineError):
        TR.fit_trees(one, ["a"], "y", "gini", n_estimators=3)


def test_criteria_share_the_passes_and_give_the_models_of_separate_fits(spark, monkeypatch):
    x, y = _data(400, 3)
    df = _frame(spark, x, y).repartition(3).cache()
    passes = []
    level_cuts = TR._level_cuts
    monkeypatch.setattr(TR, "_level_cuts", lambda *a: passes.append(1) or level_cuts(*a))
    args = dict(max_depth=4, min_samples_split=20, max_bins=128)
    together = TR.fit_trees(df, ["a", "b", "c.d"], "y", TR.NUMBER_CRITERIA, **args)
    assert list(together) == list(TR.NUMBER_CRITERIA) and len(passes) == 4       # one for each level
    for criterion in TR.NUMBER_CRITERIA:
        assert _same(_nested(together[criterion]), _grow(x, y, criterion, 4, 20))
    classes = df.withColumn("y", F.least(F.floor(F.col("y") / 6), F.lit(2)).cast("double"))
    del passes[:]
    both = TR.fit_trees(classes, ["a", "b", "c.d"], "y", ("gini", "entropy"), 3, 3, id_cols=["id"])
    assert len(passes) == 3
    for criterion, model in both.items():
        alone = TR.fit_trees(classes, ["a", "b", "c.d"], "y", criterion, 3, 3, id_cols=["id"])
        assert [n[:3] + n[4:7] for n in model.nodes] == [n[:3] + n[4:7] for n in alone.nodes]
    for wrong in ((), ("gini", "poisson"), ("poisson", "gain")):
        with pytest.raises(PipelineError):
            TR.fit_trees(df, ["a"], "y", wrong)


def test_price_tree_criteria_reads_the_rows_once_a_level(spark, monkeypatch):
    from tabwise.plans import ml_queries as Q

    passes = []
    level_cuts = TR._level_cuts
    monkeypatch.setattr(TR, "_level_cuts", lambda *a: passes.append(1) or level_cuts(*a))
    rows = Q.q_price_tree_criteria(spark, SF_SMALL).collect()
    assert {(r.criterion, r.split) for r in rows} == {(c, s) for c in TR.NUMBER_CRITERIA for s in ("train", "test")}
    assert len(passes) <= 6      # 24 when each criterion was fitted on its own


def test_few_values_across_tasks(spark):
    df = spark.range(1000, numPartitions=5).select(
        (F.col("id") % 7).cast("double").alias("a"), (F.col("id") / 100).alias("many"),
        F.floor(F.col("id") / 100).cast("double").alias("ten"), F.when(F.col("id") < 500, -0.0).otherwise(0.0).alias("zero"))
    about = df.agg(*[F.approx_count_distinct(c).alias(c) for c in df.columns]).first().asDict()
    got = TR.few_values(df, {"a": 7, "many": 7, "ten": 9, "zero": 7}, about)
    assert got == {"a": [float(v) for v in range(7)], "many": None, "ten": None, "zero": [0.0]}   # two or three of ten in a task
    assert TR.few_values(df, {"ten": 10}, about)["ten"] == [float(v) for v in range(10)]


def test_blocks_hold_every_row_and_many_codes(spark, monkeypatch):
    monkeypatch.setattr(TR, "BLOCK", 200)
    rng = np.random.default_rng(8)
    x = rng.permutation(900).astype(float)      # more bins and codes than fit a byte
    y = np.abs(x - 450) + rng.integers(0, 3, 900)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "a double, y double").repartition(4)
    for criterion in ("absolute_error", "poisson"):
        model = TR.fit_trees(df, ["a"], "y", criterion, max_depth=3, max_bins=1000, label_bins=1000)
        assert model.nodes[0][6] == 900 and _same(_nested(model), _grow(x[:, None], y, criterion, 3, 2))
