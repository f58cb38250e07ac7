import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.errors import PipelineError
from tabwise.operators import models as MO
from tabwise.operators import scoring as SC
from tabwise.sources.models_io import Bundle, load_bundle, save_bundle


def _linear_frame(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 2.0 + x @ np.array([1.5, -3.0, 0.5]) + rng.normal(scale=0.1, size=n)
    rows = [(int(i), *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double"), x, y


def test_ols_matches_normal_equations(spark):
    df, x, y = _linear_frame(spark)
    m = MO.fit_linear(df, ["a", "b", "c"], "y")
    design = np.column_stack([np.ones(len(y)), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    got = [m.estimator.intercept, *m.estimator.coefficients.toArray()]
    assert np.allclose(got, beta, atol=1e-8)


def test_logistic_matches_newton_solve_of_c1_objective(spark):
    rng = np.random.default_rng(4)
    n = 400
    x = rng.normal(size=(n, 2))
    p = 1 / (1 + np.exp(-(0.3 + x @ np.array([1.0, -2.0]))))
    y = (rng.random(n) < p).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, y double")
    m = MO.fit_logistic(df, ["a", "b"], "y", C=1.0, max_iter=1000, n_train=n)
    # Newton on 0.5*||w||^2 + C * sum(logloss), intercept unpenalised
    X = np.column_stack([np.ones(n), x])
    w = np.zeros(3)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-X @ w))
        g = X.T @ (mu - y) + np.r_[0.0, w[1:]]
        H = X.T @ (X * (mu * (1 - mu))[:, None]) + np.diag([0.0, 1.0, 1.0])
        w -= np.linalg.solve(H, g)
    got = [m.estimator.intercept, *m.estimator.coefficients.toArray()]
    assert np.allclose(got, w, atol=1e-4)


def test_tree_parameter_mapping():
    assert MO.feature_subset("sqrt", 10) == "3"  # rounds down like the original
    assert MO.feature_subset("log2", 10) == "3"
    assert MO.feature_subset(0.33, 10) == "3"
    assert MO.feature_subset(None, 10) == "all"
    with pytest.raises(PipelineError):
        MO._depth(31)


def test_min_samples_split_and_poisson_through_fit_save_load_and_score(spark, tmp_dir):
    df, _, _ = _linear_frame(spark, 120)
    df = df.withColumn("label", (F.col("y") > 2).cast("double"))
    tree = MO.fit_decision_tree(df, ["a", "b", "c"], "label", min_samples_split=30)
    rows = {r[1]: r for r in tree.nodes}
    assert all(r[6] >= 30 for r in tree.nodes if r[2] >= 0)              # what was cut was large enough
    assert any(r[6] > 2 for r in tree.nodes if r[2] < 0) and rows[0][6] == 120
    assert {r.param for r in MO.param_table(spark, tree).collect()} >= {"criterion", "min_samples_split"}
    assert MO.importance_table(spark, tree).count() == 3
    bundle = Bundle("classification", ["a", "b", "c"], {"categories": {}}, trees=tree)
    loaded = load_bundle(spark, save_bundle(spark, bundle, f"{tmp_dir}/tree"), "classification")
    scored = SC.score_classifier(df.select("id", "a", "b", "c", "label"), loaded).collect()
    right = sum(r.predicted_class == r.label for r in scored)
    assert len(scored) == 120 and right > 100
    forest = MO.fit_forest_regressor(df.withColumn("y", F.exp("b")), ["a", "b"], "y", 3, "poisson", 4, id_cols=["id"])
    stored = load_bundle(spark, save_bundle(spark, Bundle("price", ["a", "b"], trees=forest), f"{tmp_dir}/forest"), "price")
    want = {r.id: r.prediction for r in forest.transform(df).collect()}
    assert {r.id: r.prediction for r in SC.score_regressor(df, stored).collect()} == want
    with pytest.raises(PipelineError):
        MO.fit_forest_regressor(df, ["a"], "y", 3, "gini", 4)


def test_leaf_median_forest_not_worse_than_mean_leaves_on_train(spark):
    rng = np.random.default_rng(7)
    n = 600
    x = rng.uniform(0, 10, size=(n, 2))
    y = x[:, 0] * 3 + rng.standard_cauchy(n)  # heavy tails: medians help MAE
    df = spark.createDataFrame([(int(i), float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))],
                               "id long, a double, b double, y double").cache()
    med = MO.fit_forest_regressor(df, ["a", "b"], "y", 10, "absolute_error", 6, seed=1)
    mean = MO.fit_forest_regressor(df, ["a", "b"], "y", 10, "squared_error", 6, seed=1)
    mae_med = med.transform(df).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    mae_mean = mean.transform(df).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert mae_med <= mae_mean + 1e-9


def test_bundle_round_trip_same_predictions_and_kind_check(spark, tmp_dir):
    df, _, _ = _linear_frame(spark, 200)
    df = df.withColumn("label", (F.col("y") > 2).cast("double"))
    m = MO.fit_logistic(df, ["a", "b", "c"], "label")
    b = Bundle("classification", ["a", "b", "c"], {"mins": {}, "maxs": {}}, m.pipeline)
    b.extras = {"categories": {}}
    save_bundle(spark, b, f"{tmp_dir}/b")
    loaded = load_bundle(spark, f"{tmp_dir}/b", "classification")
    p1 = [r.probability_1 for r in SC.score_classifier(df, b).orderBy("id").collect()]
    p2 = [r.probability_1 for r in SC.score_classifier(df, loaded).orderBy("id").collect()]
    assert p1 == p2
    with pytest.raises(PipelineError):
        load_bundle(spark, f"{tmp_dir}/b", "kmeans")


def test_price_bundle_scores_as_the_fitted_forest_also_equal_ids_and_missing_features(spark, tmp_dir):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 10, size=(300, 2))
    df = spark.createDataFrame([(1, float(a), float(b), float(a * b)) for a, b in x], "id long, a double, b double, y double").cache()
    forest = MO.fit_forest_regressor(df, ["a", "b"], "y", 7, "absolute_error", 5, seed=2)
    bundle = Bundle("price", ["a", "b"], {}, forest.forest.pipeline, forest.leaves)
    loaded = load_bundle(spark, save_bundle(spark, bundle, f"{tmp_dir}/price"), "price")
    assert loaded.leaves == forest.leaves
    want = {(r.a, r.b): r.prediction for r in forest.transform(df).collect()}
    got = SC.score_regressor(df, loaded).collect()
    assert len(got) == 300 and {(r.a, r.b): r.prediction for r in got} == want
    # each leaf's value is the median of the training labels in it
    leaf = {(r.a, r.b): (r.y, r._leaf.toArray()) for r in forest.forest.transform(df).collect()}
    tree_0 = {}
    for y, at in leaf.values():
        tree_0.setdefault(int(at[0]), []).append(y)
    assert all(forest.leaves[0][n] == sorted(ys)[(len(ys) - 1) // 2] for n, ys in tree_0.items())
    raw = spark.createDataFrame([(5, None, "x"), (6, 2.0, "y")], "id long, a double, prediction string")
    some = SC.score_regressor(raw, loaded, "price")
    assert some.columns == ["id", "a", "prediction", "price"] and [r.a for r in some.collect()] == [None, 2.0]
    assert SC.score_regressor(raw.limit(0), loaded, "price").count() == 0


def test_score_time_encoding_missing_and_unseen(spark):
    b = Bundle("classification", ["x", "c_a", "c_b"], {"categories": {"c": ["a", "b"]}})
    raw = spark.createDataFrame([("b", 2.0), ("zzz", None)], "c string, x double")
    rows = SC.encode_raw(raw, b).collect()
    assert [(r.x, r.c_a, r.c_b) for r in rows] == [(2.0, 0.0, 1.0), (0.0, 0.0, 0.0)]


def test_tree_fits_deal_large_tables_out(spark, monkeypatch):
    """A task of a fit keeps at most about TASK_BYTES of rows, however few partitions the table has."""
    from pyspark.ml import Pipeline
    from tabwise import session
    monkeypatch.setattr(session, "TASK_BYTES", 8_000)
    seen, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, data, *a: seen.append(data.rdd.getNumPartitions()) or fit(self, data, *a))
    df = spark.range(2000).selectExpr("id", "CAST(id % 50 AS double) AS x", "CAST(id % 7 AS double) AS z", "CAST(id % 2 AS int) AS label").coalesce(2)
    MO.fit_forest_regressor(df, ["x", "z"], "label", 3, max_depth=3)
    MO.fit_random_forest(df, ["x", "z"], "label", 3, max_depth=3)
    MO.fit_decision_tree(df, ["x", "z"], "label", max_depth=3)
    MO.fit_logistic(df, ["x", "z"], "label", max_iter=3)
    assert all(n * 8_000 >= 2000 * 48 for n in seen) and seen[0] * 8_000 >= 2000 * MO.tree_bytes(2, 3, 3), seen


def test_price_workflow_deals_the_training_rows_out_once(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from tabwise import session
    from tabwise.plans import workflows as WF
    monkeypatch.setattr(session, "TASK_BYTES", 8_000)
    seen, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, data, *a: seen.append(data.rdd.getNumPartitions()) or fit(self, data, *a))
    df = spark.range(2000).selectExpr("id", "CAST(id % 50 AS double) AS x", "CAST(id * id % 97 AS double) AS price")
    res = WF.regression_workflow(spark, df, "id", use_stratify=False, n_estimators=3, max_depth=3)
    assert all(n * 8_000 >= 1600 * MO.tree_bytes(1, 3, 3) for n in seen), seen
    assert {(r["model"], r["split"], r["n"]) for r in res.mae.collect()} == {
        (m, s, n) for m in ("linear_regression", "random_forest") for s, n in (("train", 1600), ("test", 400))}


def test_leaf_medians_of_few_and_many_leaves_are_the_middle_rows(spark, monkeypatch):
    rng = np.random.default_rng(11)
    n, sizes = 6000, [5, 1, 40]
    y = np.concatenate([rng.lognormal(0, 6, n - 2500), np.full(1500, 7.25), -rng.integers(0, 4, 1000).astype(float)])
    leaf = np.column_stack([rng.choice([0, 1, 2, 4], n), np.zeros(n, int), np.minimum(rng.geometric(0.2, n), 40) - 1])   # leaf 3 of the first tree is empty
    rows = spark.createDataFrame([(float(v), [float(c) for c in r]) for v, r in zip(y, leaf)], "y double, leaf array<double>").repartition(5).cache()

    def middle(tree, number):
        values = np.sort(y[leaf[:, tree] == number])
        return values[(len(values) - 1) // 2] if len(values) else None

    want = [[middle(t, k) for k in range(size)] for t, size in enumerate(sizes)]
    clean = lambda got: [[None if np.isnan(v) else v for v in tree] for tree in got]
    assert clean(MO.leaf_medians(rows, sizes)) == want
    monkeypatch.setattr(MO, "LEAF_ROWS", 0)                 # down to single values
    monkeypatch.setattr(MO, "LEAF_BUCKETS", 4)
    monkeypatch.setattr(MO, "LEAF_CELLS", 5 * 4)            # the third tree has too many leaves, and each other its own pass
    got = clean(MO.leaf_medians(rows, sizes))
    assert got[:2] == want[:2]
    for number, value in enumerate(got[2]):
        values = np.sort(y[leaf[:, 2] == number])
        near = (len(values) - 1) // 2 + np.arange(-2, 3)
        assert (value is None) == (len(values) == 0) and (value is None or value in values[np.clip(near, 0, len(values) - 1)])
