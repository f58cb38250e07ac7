from pyspark.sql import functions as F

from tabwise.operators import models as MO
from tabwise.operators import tuning as TU


def test_regression_scoring_fills_missing_features_with_zero(spark):
    train = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i + 5 * (i % 3) + 1) for i in range(30)],
                                  "a double, b double, y double")
    m = MO.fit_linear(train, ["a", "b"], "y")
    fresh = spark.createDataFrame([(10.0,), (None,)], "a double")   # b absent, a NULL in row 2
    preds = [r.prediction for r in m.transform(fresh).collect()]
    assert abs(preds[0] - 21.0) < 1e-6 and abs(preds[1] - 1.0) < 1e-6


def test_comparison_table_and_best_model(spark):
    a = spark.createDataFrame([("test", 0.7)], "split string, accuracy double")
    b = spark.createDataFrame([("test", 0.8)], "split string, accuracy double")
    c = spark.createDataFrame([("test", 0.8)], "split string, accuracy double")
    table = TU.comparison_table({"m_a": a, "m_c": c, "m_b": b}, "accuracy")
    assert [r.model for r in table.collect()] == ["m_b", "m_c", "m_a"]
    assert TU.best_model(table, "accuracy").model == "m_b"
    assert TU.best_model(table, "accuracy", maximise=False).model == "m_a"


def test_cv_summary_population_std_and_text(spark):
    scores = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.6)], "fold int, score double")
    row = TU.cv_summary(scores).first()
    assert abs(row.mean_score - 0.6) < 1e-12
    assert abs(row.std_score - (((0.01 + 0.01 + 0.0) / 3) ** 0.5)) < 1e-12
    assert row.n_folds == 3 and row.scores == "0.5000, 0.7000, 0.6000"


def test_cross_validate_fold_counts(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 2)) for i in range(60)], "id long, x double, label double")

    def fit(part):
        return MO.fit_logistic(part, ["x"], "label", max_iter=50)

    def predict(model, part):
        return model.transform(part).withColumn("prediction", F.col("prediction").cast("int"))

    cv = TU.cross_validate(spark, df, "id", "label", fit, predict, folds=4, stratified=True, seed=1).collect()
    assert sorted(r.n_test for r in cv) == [15, 15, 15, 15]
    assert all(r.n_train + r.n_test == 60 for r in cv)


def test_large_folds_are_dealt_out_and_fitted_one_by_one(spark, monkeypatch):
    import threading
    from tabwise import session
    from tabwise.operators import tuning as TU
    monkeypatch.setattr(session, "TASK_BYTES", 8_000)
    df = spark.range(1000).selectExpr("id", "CAST(id % 3 = 0 AS int) AS label").coalesce(2)
    running, most, parts, lock = [0], [0], [], threading.Lock()

    def fit(part):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        parts.append(part.rdd.getNumPartitions())
        threading.Event().wait(0.3)
        with lock:
            running[0] -= 1
        return None

    rows = TU.cross_validate(spark, df, "id", "label", fit, lambda m, part: part.selectExpr("label", "0 AS prediction"), 5, True).orderBy("fold").collect()
    assert most[0] == 1 and min(parts) * 8_000 >= 1000 * TU.FIT_BYTES
    assert [(r["n_train"], r["n_test"]) for r in rows] == [(800, 200)] * 5
    assert sum(r["score"] * r["n_test"] for r in rows) == 666
