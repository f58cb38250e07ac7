import math

import pytest
from pyspark.sql import functions as F

from tabwise.errors import PipelineError
from tabwise.operators import scoring as SC
from tabwise.plans import presets as P
from tabwise.sources.models_io import load_bundle, save_bundle
from tests import fixtures as FX


def test_loan_workflow_end_to_end(spark, tmp_dir):
    df = P.load_loan(spark, FX.loan_csv(tmp_dir))
    res = P.run_loan(spark, df, forest_trees=20)
    assert "Dependents_3+" in res.features and "Credit_History" in res.features
    sizes = {r.split: r["count"] for r in res.split.groupBy("split").count().collect()}
    assert sizes == {"test": math.ceil(0.2 * 614), "train": 614 - math.ceil(0.2 * 614)}
    # every imputed column is complete after imputation; the target is 0/1
    assert res.split.where(F.col("label").isNull()).count() == 0
    test = {r.model: r for r in res.comparison.collect()}
    assert set(test) == {"logistic", "decision_tree", "random_forest"}
    assert test["logistic"].accuracy >= 0.76            # published target on the real data
    cv = res.cv_scores.collect()
    assert len(cv) == 5 and sum(r.n_test for r in cv) == sizes["train"]
    assert res.defaults["Loan_Amount_Term"] == 360.0
    path = f"{tmp_dir}/loan_bundle"
    save_bundle(spark, res.bundle, path)
    bundle = load_bundle(spark, path, "classification")
    scored = SC.score_classifier(df.drop("Loan_Approved"), bundle)
    assert scored.where(F.col("predicted_class").isNull()).count() == 0
    assert scored.count() == 614


def test_loan_rejects_unknown_target_values(spark, tmp_dir):
    df = P.load_loan(spark, FX.loan_csv(tmp_dir)).withColumn(
        "Loan_Approved", F.when(F.col("Loan_ID") == "LP000005", F.lit("maybe")).otherwise(F.col("Loan_Approved")))
    with pytest.raises(PipelineError):
        P.run_loan(spark, df, forest_trees=5)


def test_admission_workflow_end_to_end(spark, tmp_dir):
    df = P.load_admission(spark, FX.admission_csv(tmp_dir))
    res = P.run_admission(spark, df)
    assert res.features == ["GRE_Score", "TOEFL_Score", "SOP", "LOR", "CGPA", "University_Rating_1",
                            "University_Rating_2", "University_Rating_3", "University_Rating_4",
                            "University_Rating_5", "Research_0", "Research_1"]
    m = {r.split: r for r in res.metrics.collect()}
    assert m["train"].tp + m["train"].fp + m["train"].fn + m["train"].tn == 400
    assert m["test"].accuracy >= 0.8
    assert res.loss.count() == len(res.model.loss_curve) <= 200
    scored = SC.score_mlp(df, res.bundle)
    assert scored.where(F.col("probability_1").isNull()).count() == 0


def test_admission_rejects_non_numeric(spark, tmp_dir):
    df = P.load_admission(spark, FX.admission_csv(tmp_dir)).withColumn("CGPA", F.lit(None).cast("double"))
    with pytest.raises(PipelineError):
        P.run_admission(spark, df)


def test_segmentation_workflow_finds_generated_blobs(spark, tmp_dir):
    df = P.load_mall(spark, FX.mall_csv(tmp_dir))
    res = P.run_segmentation(spark, df, k=5, n_init=3)
    best = res.diagnostics.orderBy(F.desc("Silhouette_Score"), "cluster").first()
    assert best.cluster == 5
    prof = res.profile.collect()
    assert len(prof) == 5 and sum(r.Customers for r in prof) == 200
    named = res.named.select("Segment").distinct().count()
    assert 1 <= named <= 4
    wcss = [r.WCSS_Score for r in res.diagnostics.orderBy("cluster").collect()]
    assert all(a >= b for a, b in zip(wcss, wcss[1:]))


def test_price_workflow_stratified_and_singular_design(spark):
    df = spark.createDataFrame(FX.price_rows(), FX.PRICE_SCHEMA)
    res = P.run_price(spark, df, "id", n_estimators=10, max_depth=8)
    assert res.stratify_used == "property_type_Condo"
    rows = {(r.model, r.split): r.mae for r in res.mae.collect()}
    assert set(rows) == {(m, s) for m in ("linear_regression", "random_forest") for s in ("train", "test")}
    # redundant one-hot pair (Condo + House = 1): the fit still predicts well
    assert rows[("linear_regression", "test")] < 25000
    no_strat = P.run_price(spark, df.drop("property_type_Condo"), "id", n_estimators=5, max_depth=4)
    assert no_strat.stratify_used is None


def test_loan_constant_fill_variant(spark, tmp_dir):
    df = P.load_loan(spark, FX.loan_csv(tmp_dir))
    res = P.run_loan(spark, df, forest_trees=5, cv_folds=0, fill_constants={"Gender": "Male"})
    assert res.defaults["Gender"] == "Male"
    assert res.cv_scores is None
