import random

import pytest
from pyspark.sql import functions as F

from tabwise.errors import PipelineError
from tabwise.operators import encoding as EN
from tabwise.operators import models as MO
from tabwise.operators import prep as PR
from tabwise.operators import scoring as SC
from tabwise.plans import workflows as WF
from tabwise.sources.models_io import Bundle, load_bundle, save_bundle


def test_places_follow_columns_then_values(spark):
    df = spark.createDataFrame([(10, "b", 1.5), (9, "a", float("nan")), (10, None, -0.0), (None, "B", 0.0)], "n long, t string, x double")
    words = EN.fit_categories(df, ["n", "t", "x"])
    rows = sorted((r["place"], r["k"], r["category"], r["n"]) for r in words.entries.collect())
    assert rows == [(0, 0, "9", 1), (1, 0, "10", 2), (2, 1, "B", 1), (3, 1, "a", 1), (4, 1, "b", 1), (5, 2, "0.0", 2), (6, 2, "1.5", 1)]
    assert (words.width, words.sizes) == (7, [2, 3, 2])
    got = EN.category_places(df, words).collect()
    assert {(r["n"], r["t"], tuple(r["places"])) for r in got} == {(10, "b", (1, 4, 6)), (9, "a", (0, 3)), (10, None, (1, 5)), (None, "B", (2, 5))}
    names = {r["place"]: r["feature"] for r in EN.feature_names(words, ["z"]).collect()}
    assert names[0] == "z" and names[1] == "n_9" and names[3] == "t_B" and len(names) == 8


def test_sparse_vectors_equal_dense_dummies(spark, tmp_dir):
    rng = random.Random(4)
    values = ["x.y", "Male", "male", "a`b", "", "z"]
    df = spark.createDataFrame([(i, rng.choice(values + [None]), rng.randint(1, 5), rng.choice([None, 0.0, 1 / 3, 1e-300])) for i in range(300)],
                               "id long, `c.d` string, e int, y double").repartition(7)
    words = EN.fit_categories(df, ["c.d", "e"])
    words.save(f"{tmp_dir}/words")
    words = EN.CategoryDictionary.load(spark, f"{tmp_dir}/words")
    fresh = df.unionByName(spark.createDataFrame([(900, "new", 77, 2.0)], df.schema))
    out = EN.sparse_one_hot(fresh, words, ["y", "absent"], "v")
    assert out.columns == [*df.columns, "v"]
    got = {r["id"]: r["v"] for r in out.collect()}
    dense = PR.apply_one_hot(fresh, PR.fit_one_hot(df, ["c.d", "e"]))
    want = {r[0]: [r[1] or 0.0, 0.0, *r[2:]] for r in dense.collect()}
    assert {i: v.toArray().tolist() for i, v in got.items()} == {i: [float(x) for x in row] for i, row in want.items()}
    assert all(len(v.indices) <= 3 for v in got.values())
    no_column = EN.sparse_one_hot(df.drop("c.d"), words, [], "v")
    assert all(r["v"].size == words.width and len(r["v"].indices) == 1 for r in no_column.collect())


def test_very_many_categories_with_a_hot_one(spark):
    """10^6 categories, and a third of all rows in one more: found without a bound on either."""
    df = spark.range(1_500_000).select("id", F.when(F.col("id") < 1_000_000, F.col("id")).otherwise(F.lit(-5)).alias("c"))
    words = EN.fit_categories(df, ["c"])
    assert words.width == 1_000_001 and words.cold == [1_000_000]
    placed = EN.category_places(df, words)
    wrong = placed.where(F.col("places")[0] != F.when(F.col("id") < 1_000_000, F.col("id") + 1).otherwise(F.lit(0)))
    assert wrong.count() == 0 and placed.where(F.size("places") == 1).count() == 1_500_000


def test_empty_table_and_absent_columns(spark):
    none = spark.createDataFrame([], "c string, x double")
    words = EN.fit_categories(none, ["c"])
    assert words.width == 0 and EN.sparse_one_hot(none, words, ["x"]).count() == 0
    some = spark.createDataFrame([("a", 2.0)], "c string, x double")
    assert EN.sparse_one_hot(some, words, ["x"]).first()["features"].toArray().tolist() == [2.0]
    assert EN.fit_categories(some, []).width == 0
    with pytest.raises(PipelineError):
        EN.fit_categories(some, ["d"])


def test_sparse_logistic_equals_dense(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("abc"), rng.random()) for i in range(400)]
    df = spark.createDataFrame([(i, c, x, int(rng.random() < (0.8 if c == "a" else 0.2 + 0.4 * x))) for i, c, x in rows], "id long, c string, x double, label int")
    words = EN.fit_categories(df, ["c"])
    sparse = MO.fit_logistic(EN.sparse_one_hot(df, words, ["x"]), "features", "label")
    encoded, _ = PR.one_hot(df, ["c"])
    dense = MO.fit_logistic(encoded, ["x", "c_a", "c_b", "c_c"], "label")
    assert sparse.estimator.coefficients.toArray() == pytest.approx(dense.estimator.coefficients.toArray(), abs=1e-6)
    scored = sparse.transform(EN.sparse_one_hot(df, words, ["x"], "v").withColumnRenamed("v", "features"))
    assert scored.where(F.col("prediction") == F.col("label")).count() > 250


NAMES = ["B.Sc", "b.sc", "Male", "male", "a`b"]


def test_any_category_names_fit_save_load_and_score(spark, tmp_dir):
    """Names with dots and backticks, or that differ only in case, from the workflow to scoring a loaded bundle."""
    rng = random.Random(2)
    df = spark.createDataFrame([(i, NAMES[i % 5], rng.random(), "Y" if i % 5 in (0, 2) else "N") for i in range(200)],
                               "id long, `study.level` string, `x.1` double, status string")
    cfg = WF.ClassificationConfig(id_col="id", target="status", mapping={"Y": 1, "N": 0}, mode_cols=["study.level"], median_cols=["x.1"],
                                  categorical_cols=["study.level"], numeric_cols=["x.1"], cv_folds=0, forest_trees=5, forest_max_depth=4)
    res = WF.classification_workflow(spark, df, cfg)
    assert res.features == ["x.1", *sorted(f"study.level_{n}" for n in NAMES)]
    assert res.split.columns == ["id", *res.features, "label", "split"]
    accuracy = {r["model"]: r["accuracy"] for r in res.comparison.collect()}
    assert accuracy["decision_tree"] == 1.0 and accuracy["logistic"] == 1.0
    assert {r["term"] for r in MO.coefficient_table(spark, res.models["logistic"]).collect()} == {"intercept", *res.features}
    bundle = load_bundle(spark, save_bundle(spark, res.bundle, f"{tmp_dir}/b"), "classification")
    raw = df.select("id", "`study.level`", "`x.1`")
    got = {r["id"]: r["predicted_class"] for r in SC.score_classifier(raw, bundle).select("id", "predicted_class").collect()}
    assert got == {i: int(i % 5 in (0, 2)) for i in range(200)}


def test_price_model_with_dotted_names(spark, tmp_dir):
    df = spark.createDataFrame([(i, float(i), float(i % 7), 3.0 * i + i % 7) for i in range(50)], "id long, `a.b` double, `A.b` double, y double")
    model = MO.fit_linear(df, ["a.b", "A.b"], "y")
    bundle = load_bundle(spark, save_bundle(spark, Bundle("price", model.features, {}, model.pipeline), f"{tmp_dir}/p"), "price")
    out = SC.score_regressor(df, bundle, "price")
    assert out.columns == [*df.columns, "price"]
    assert all(r[4] == pytest.approx(r[3]) for r in out.collect())
