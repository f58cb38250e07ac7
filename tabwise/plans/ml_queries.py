"""Model queries: the four workflows run on the driver tables (rows-only checks).

Iterative fits have no SQL twin; their correctness is covered by closed-form
and property tests.  A workflow result is memoised per (session, sf_dir) so
the several tables it produces (metrics, coefficients, CV scores, …) come
from one fit.  Query-level settings (tree depth, number of trees, restarts)
are chosen per query and stated next to it; workflow defaults follow the
original notebooks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.operators import cluster as CL
from tabwise.operators import metrics as ME
from tabwise.operators import models as MO
from tabwise.operators import scoring as SC
from tabwise.operators import trees as TR
from tabwise.operators import tuning as TU
from tabwise.plans import tables as T
from tabwise.plans import workflows as WF
from tabwise.plans.catalog import register
from tabwise.session import ensure_checkpoint_dir
from tabwise.sources.models_io import load_bundle, save_bundle
from tabwise.sources.tables import read_table

_MEMO: dict = {}


def _memo(key: str, spark: SparkSession, sf_dir: str, build):
    k = (key, id(spark), spark.sparkContext.applicationId, sf_dir)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double"
                      else F.col(f.name) for f in df.schema.fields])


# =============================================================================== eligibility
def eligibility_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders (gaps in amount and priority) ⋈ customer (gaps in segment); Y/N target = status F."""
    og = T.orders_with_gaps(spark, sf_dir)
    raw_status = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    cust = T.customer_with_gaps(spark, sf_dir).select("c_custkey", "c_acctbal", "c_mktsegment")
    return (og.drop("o_orderstatus").join(raw_status, "o_orderkey")
            .join(cust, og["o_custkey"] == cust["c_custkey"], "inner")
            .select("o_orderkey",
                    F.when(F.col("o_orderstatus") == "F", F.lit("Y")).otherwise(F.lit("N")).alias("approved"),
                    "o_totalprice", "o_orderpriority", "c_acctbal", "c_mktsegment"))


ELIGIBILITY = WF.ClassificationConfig(
    id_col="o_orderkey", target="approved",
    mode_cols=["o_orderpriority", "c_mktsegment"], median_cols=["o_totalprice"],
    categorical_cols=["o_orderpriority", "c_mktsegment"], numeric_cols=["o_totalprice", "c_acctbal"],
    # query settings: bounded trees keep the per-round run short; defaults are 30 / 100 trees
    tree_max_depth=8, forest_trees=30, forest_max_depth=8, cv_folds=5, cv_stratified=True)


def eligibility(spark, sf_dir) -> WF.ClassificationResult:
    return _memo("eligibility", spark, sf_dir,
                 lambda: WF.classification_workflow(spark, eligibility_input(spark, sf_dir), ELIGIBILITY))


@register("eligibility_model_comparison")
def q_eligibility_model_comparison(spark, sf_dir):
    """E3/E4/E5 + X5 + A22 + M7: test metrics of logistic, tree and forest, best first."""
    res = eligibility(spark, sf_dir)
    return _r(res.comparison.select("model", "split", "threshold", "tp", "fp", "fn", "tn",
                                    "accuracy", "precision", "recall", "f1"))


@register("eligibility_train_test_metrics")
def q_eligibility_train_test_metrics(spark, sf_dir):
    """A22 on both sides of the split for each model (one aggregation per model)."""
    return _r(eligibility(spark, sf_dir).metrics)


@register("eligibility_confusion")
def q_eligibility_confusion(spark, sf_dir):
    """A23 for the logistic model on the test rows."""
    return eligibility(spark, sf_dir).confusion["logistic"]


@register("eligibility_cv_scores")
def q_eligibility_cv_scores(spark, sf_dir):
    """Stratified 5-fold CV of the logistic model on the scaled training rows."""
    return _r(eligibility(spark, sf_dir).cv_scores)


@register("eligibility_cv_summary")
def q_eligibility_cv_summary(spark, sf_dir):
    """A25 + F10: mean / population std of fold accuracies, and the scores as text."""
    return _r(TU.cv_summary(eligibility(spark, sf_dir).cv_scores))


@register("logistic_coefficients")
def q_logistic_coefficients(spark, sf_dir):
    """M1 for the logistic model, sorted by |coefficient| (L3)."""
    res = eligibility(spark, sf_dir)
    t = MO.coefficient_table(spark, res.models["logistic"])
    return _r(t.orderBy(F.desc(F.abs("estimate")), "term"))


@register("forest_importances")
def q_forest_importances(spark, sf_dir):
    """M2: random-forest feature importances, descending (L4)."""
    return _r(MO.importance_table(spark, eligibility(spark, sf_dir).models["random_forest"]))


@register("tree_params")
def q_tree_params(spark, sf_dir):
    """M3: decision-tree parameters as rows."""
    return MO.param_table(spark, eligibility(spark, sf_dir).models["decision_tree"])


@register("eligibility_defaults", f"""WITH {T.ORDERS_WITH_GAPS_SQL}, {T.CUSTOMER_WITH_GAPS_SQL},
i AS (SELECT o_totalprice, o_orderpriority, c_acctbal, c_mktsegment FROM og JOIN cg ON o_custkey = c_custkey)
SELECT 'o_orderpriority' AS column_name, (SELECT o_orderpriority FROM i WHERE o_orderpriority IS NOT NULL
         GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS text_value, CAST(NULL AS DOUBLE) AS num_value
UNION ALL SELECT 'c_mktsegment', (SELECT c_mktsegment FROM i WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), NULL
UNION ALL SELECT 'o_totalprice', NULL, median(o_totalprice) FROM i
UNION ALL SELECT 'c_acctbal', NULL, median(c_acctbal) FROM i""")
def q_eligibility_defaults(spark, sf_dir):
    """Default raw values (mode per category, median per number) kept in the bundle."""
    d = eligibility(spark, sf_dir).defaults
    rows = [(k, None if isinstance(v, (int, float)) else str(v),
             float(v) if isinstance(v, (int, float)) else None) for k, v in d.items()]
    return spark.createDataFrame(rows, "column_name string, text_value string, num_value double")


@register("eligibility_scoring")
def q_eligibility_scoring(spark, sf_dir):
    """S7/S8 + T8 + X2: save the bundle, load it back (kind checked), score every raw row."""
    res = eligibility(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/bundles/eligibility-{uuid.uuid4().hex}"
    save_bundle(spark, res.bundle, path)
    bundle = load_bundle(spark, path, "classification")
    raw = eligibility_input(spark, sf_dir).drop("approved")
    scored = SC.score_classifier(raw, bundle, 0.5)
    return scored.select("o_orderkey", F.round("probability_1", 6).alias("probability_1"), "predicted_class")


def _cv_models(spark, sf_dir) -> DataFrame:
    res, c = eligibility(spark, sf_dir), ELIGIBILITY
    train = WF.PR.apply_minmax(res.split, res.scaler).where(F.col("split") == "train").drop("split")
    fits = {"logistic": lambda part: MO.fit_logistic(part, res.features, "label", c.logistic_C, c.logistic_max_iter),
            "decision_tree": lambda part: MO.fit_decision_tree(part, res.features, "label", c.tree_criterion, c.tree_max_depth, seed=c.seed),
            "random_forest": lambda part: MO.fit_random_forest(part, res.features, "label", c.forest_trees, c.forest_criterion,
                                                               c.forest_max_depth, c.forest_max_features, seed=c.seed)}

    def predict(model, part):
        return model.transform(part).withColumn("prediction", F.col("prediction").cast("int"))

    return _memo("cv_models", spark, sf_dir, lambda: TU.cross_validate_models(
        spark, train, c.id_col, "label", fits, predict, c.cv_folds, c.cv_stratified, c.seed))


@register("eligibility_cv_models")
def q_eligibility_cv_models(spark, sf_dir):
    """Cross-validation of all three classifiers on the same folds, one row a model and fold."""
    return _r(_cv_models(spark, sf_dir))


@register("eligibility_cv_models_summary")
def q_eligibility_cv_models_summary(spark, sf_dir):
    """A25 + F10: mean, population std and fold scores of each classifier."""
    return _r(TU.cv_summary(_cv_models(spark, sf_dir), ["model"]))


@register("tree_depth_trials")
def q_tree_depth_trials(spark, sf_dir):
    """A small hyperparameter grid (tree depth) scored by 3-fold stratified CV."""
    res = eligibility(spark, sf_dir)
    train = WF.PR.apply_minmax(res.split, res.scaler).where(F.col("split") == "train").drop("split")

    def make_fit(cfg):
        return lambda part: MO.fit_decision_tree(part, res.features, "label", cfg["criterion"],
                                                 cfg["max_depth"], seed=42)

    def predict(model, part):
        return model.transform(part).withColumn("prediction", F.col("prediction").cast("int"))

    grid = [{"criterion": c, "max_depth": d} for c in ("gini", "entropy") for d in (3, 6)]
    return _r(TU.parameter_trials(spark, train, "o_orderkey", "label", grid, make_fit, predict, 3, True, 42))


# =============================================================================== price regression
def price_input(spark, sf_dir) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
                     (F.col("l_returnflag") == "R").cast("int").alias("returned"))


def price(spark, sf_dir) -> WF.RegressionResult:
    # query settings: 20 trees of depth 8 (workflow default: 200 unlimited-depth trees)
    return _memo("price", spark, sf_dir, lambda: WF.regression_workflow(
        spark, price_input(spark, sf_dir), ["l_orderkey", "l_linenumber"], "l_extendedprice", "returned",
        True, 0.2, 42, n_estimators=20, criterion="absolute_error", max_depth=8))


@register("price_model_mae")
def q_price_model_mae(spark, sf_dir):
    """E1 + E2 (leaf-median forest) + A21 train/test MAE + M7 comparison."""
    return _r(price(spark, sf_dir).mae.select("model", "split", "n", "mae"), 4)


@register("price_coefficients")
def q_price_coefficients(spark, sf_dir):
    """M1 for the OLS model, sorted by |coefficient|."""
    t = MO.coefficient_table(spark, price(spark, sf_dir).linear)
    return _r(t.orderBy(F.desc(F.abs("estimate")), "term"), 6)


ROOT_CRITERIA = ("squared_error", "friedman_mse", "poisson")


@register("tree_root_cuts", """WITH t AS (
  SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_discount AS DOUBLE) AS l_discount,
         CAST(l_tax AS DOUBLE) AS l_tax, CAST(l_returnflag = 'R' AS DOUBLE) AS returned FROM lineitem),
u AS (UNPIVOT t ON l_quantity, l_discount, l_tax, returned INTO NAME feature VALUE x),
g AS (SELECT feature, x, count(*) AS n, sum(y - (SELECT avg(y) FROM t)) AS s FROM u GROUP BY 1, 2),
c AS (SELECT feature, x, lead(x) OVER w AS above, sum(n) OVER w AS nl, sum(s) OVER w AS sl,
             sum(n) OVER (PARTITION BY feature) AS n, sum(s) OVER (PARTITION BY feature) AS s
      FROM g WINDOW w AS (PARTITION BY feature ORDER BY x)),
m AS (SELECT feature, (x + above) / 2 AS threshold, nl, n - nl AS nr, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS square,
             (sl + nl * a) * ln(sl / nl + a) + (s - sl + (n - nl) * a) * ln((s - sl) / (n - nl) + a) - (s + n * a) * ln(s / n + a) AS dev
      FROM c, (SELECT avg(y) AS a FROM t) WHERE above IS NOT NULL),
k(criterion) AS (VALUES ('squared_error'), ('friedman_mse'), ('poisson')),
r AS (SELECT *, row_number() OVER (PARTITION BY criterion ORDER BY CASE criterion WHEN 'poisson' THEN dev ELSE square END DESC) AS place FROM m, k)
SELECT criterion, feature, round(threshold, 6) AS threshold, CAST(nl AS BIGINT) AS n_left, CAST(nr AS BIGINT) AS n_right,
       round(CASE criterion WHEN 'poisson' THEN dev ELSE square END / (nl + nr), 4) AS gain_per_row
FROM r WHERE place = 1""")
def q_tree_root_cuts(spark, sf_dir):
    """The first cut of a price tree by each moment criterion, on all rows."""
    data, features = price_input(spark, sf_dir), ["l_quantity", "l_discount", "l_tax", "returned"]
    rows = []
    for criterion in ROOT_CRITERIA:
        nodes = TR.fit_trees(data, features, "l_extendedprice", criterion, max_depth=1).nodes
        _, _, feature, threshold, left, right, n, gain, _ = nodes[0]
        rows.append((criterion, features[feature], round(threshold, 6), nodes[left][6], nodes[right][6], round(gain / n, 4)))
    return spark.createDataFrame(rows, "criterion string, feature string, threshold double, n_left bigint, n_right bigint, gain_per_row double")


@register("price_tree_criteria")
def q_price_tree_criteria(spark, sf_dir):
    """E2 + A21: train/test MAE of a price tree by each criterion, nodes of fewer than 100 rows uncut (depth 6)."""
    res = price(spark, sf_dir)
    train = res.split.where(F.col("split") == "train")
    models = TR.fit_trees(train, res.features, "l_extendedprice", TR.NUMBER_CRITERIA, max_depth=6, min_samples_split=100)
    scored = res.split.select("split", F.col("l_extendedprice").alias("label"), *res.features)
    for criterion, model in models.items():     # side by side, so that every row is read once
        scored = model.transform(scored).withColumnRenamed("prediction", criterion)
    stacked = scored.selectExpr("split", "label", f"stack({len(models)}, {', '.join(f"'{c}', {c}" for c in models)}) AS (criterion, prediction)")
    errors = ME.mae(stacked, "label", "prediction", ["criterion", "split"]).persist()       # two rows a criterion
    errors.count()
    tables = {criterion: errors.where(F.col("criterion") == criterion).drop("criterion") for criterion in models}
    return _r(TU.comparison_table(tables, "mae", descending=False).withColumnRenamed("model", "criterion")
              .select("criterion", "split", "n", "mae"), 4)


@register("price_scoring")
def q_price_scoring(spark, sf_dir):
    """S7/S8 + X1: both price models saved, loaded (kind checked) and applied to every raw row."""
    res = price(spark, sf_dir)
    base = f"{ensure_checkpoint_dir(spark)}/bundles/price-{uuid.uuid4().hex}"
    scored = price_input(spark, sf_dir).drop("l_extendedprice")
    for name, out_col in (("linear_regression", "linear_price"), ("random_forest", "forest_price")):
        path = save_bundle(spark, res.bundles[name], f"{base}/{name}")
        scored = SC.score_regressor(scored, load_bundle(spark, path, "price"), out_col)
    return _r(scored.select("l_orderkey", "l_linenumber", "linear_price", "forest_price"), 2)


# =============================================================================== segmentation
def segmentation(spark, sf_dir) -> WF.SegmentationResult:
    cust = T.customer_with_gaps(spark, sf_dir)
    # query settings: 3 restarts (workflow default: 10)
    return _memo("segmentation", spark, sf_dir, lambda: WF.segmentation_workflow(
        spark, cust, "c_custkey", ["c_acctbal", "c_nationkey"], 5,
        {"Average_Balance": "c_acctbal", "Average_Nation": "c_nationkey"},
        ("Building_Percent", "c_mktsegment", "building"), "Average_Balance", "Average_Nation",
        init="k-means++", n_init=3, max_iter=300, seed=42))


@register("segmentation_profile")
def q_segmentation_profile(spark, sf_dir):
    """E6 + A18/A19 + A20: K-means clusters profiled and named."""
    res = segmentation(spark, sf_dir)
    return _r(res.profile.join(res.names, "Cluster"), 4)


@register("segment_assignment")
def q_segment_assignment(spark, sf_dir):
    """X4 + J1 + P11/P12: every customer with its cluster and segment name (second column)."""
    res = segmentation(spark, sf_dir)
    return res.named.select("c_custkey", "Segment", "Cluster", "c_acctbal", "c_nationkey")


@register("segmentation_correlation", """WITH k AS (
  SELECT CAST(c_acctbal AS DOUBLE) AS a, CAST(c_nationkey AS DOUBLE) AS b,
         rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS ra,
         rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS rb FROM customer),
v AS (SELECT 'pearson' AS method, round(corr(a, b), 6) AS c FROM k UNION ALL SELECT 'spearman', round(corr(ra, rb), 6) FROM k),
n(x) AS (VALUES ('c_acctbal'), ('c_nationkey'))
SELECT p.x AS col_a, q.x AS col_b, CASE WHEN p.x = q.x THEN 1.0 ELSE c END::DOUBLE AS corr, method FROM v, n p, n q""")
def q_segmentation_correlation(spark, sf_dir):
    """A12 + A13 on the clustering features."""
    res = segmentation(spark, sf_dir)
    p = res.pearson.withColumn("method", F.lit("pearson"))
    s = res.spearman.withColumn("method", F.lit("spearman"))
    return _r(p.unionByName(s))


@register("kmeans_diagnostics")
def q_kmeans_diagnostics(spark, sf_dir):
    """WCSS and silhouette for k = 3..8 on the embeddings (2 restarts per k)."""
    def build():
        emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        return _r(CL.cluster_diagnostics(emb, "embedding", range(3, 9), "k-means++", n_init=2, max_iter=100,
                                         seed=42))
    return _memo("kmeans_diagnostics", spark, sf_dir, build)


@register("kmeans_centres")
def q_kmeans_centres(spark, sf_dir):
    """M4: centres and sizes of a 10-cluster fit on the embeddings."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding").persist()
    res = CL.fit_kmeans(emb, "embedding", 10, "k-means++", n_init=1, max_iter=100, seed=42)
    return _r(CL.centre_table(spark, res))


# =============================================================================== MLP (admission)
def admission(spark, sf_dir) -> WF.MLPResult:
    emb = read_table(spark, sf_dir, "embeddings")
    return _memo("admission", spark, sf_dir, lambda: WF.mlp_workflow(
        spark, emb, "vec_id", "label", [], [], threshold=5, test_size=0.2, seed=123, hidden=(3, 4),
        activation="relu", batch_size=50, learning_rate=1e-3, alpha=1e-4, max_iter=200,
        vector_col="embedding"))


@register("mlp_metrics")
def q_mlp_metrics(spark, sf_dir):
    """E7 + P4 + A22: MLP (3,4) relu/Adam accuracy, precision, recall, F1 on train and test."""
    return _r(admission(spark, sf_dir).metrics)


@register("mlp_confusion")
def q_mlp_confusion(spark, sf_dir):
    """A23 for the MLP on the test rows."""
    return admission(spark, sf_dir).confusion


@register("mlp_loss_curve")
def q_mlp_loss_curve(spark, sf_dir):
    """M5: training loss per epoch."""
    return _r(admission(spark, sf_dir).loss)


@register("mlp_layers")
def q_mlp_layers(spark, sf_dir):
    """M6: layer table."""
    return admission(spark, sf_dir).layers


# =============================================================================== streaming
@register("streaming_scoring")
def q_streaming_scoring(spark, sf_dir):
    """X4 on a stream: the customer table read as a file stream and scored with the K-means
    bundle of the segmentation workflow (stateless projection), written through a
    checkpointed parquet sink with an availableNow trigger, then read back."""
    from tabwise.streaming.scoring import score_stream
    res = segmentation(spark, sf_dir)
    bundle = res.bundle
    base = ensure_checkpoint_dir(spark)
    run = uuid.uuid4().hex
    cust_schema = read_table(spark, sf_dir, "customer").schema
    stream = (spark.readStream.format("parquet").schema(cust_schema)
              .option("pathGlobFilter", "customer.parquet").load(sf_dir))
    q = score_stream(stream, lambda df: SC.assign_clusters(df, bundle).select("c_custkey", "Cluster"),
                     f"{base}/stream-out-{run}", f"{base}/stream-ckpt-{run}")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/stream-out-{run}")


# =============================================================================== L2 / L5 / L6 / X3
@register("prediction_preview")
def q_prediction_preview(spark, sf_dir):
    """L2: the first 10 test predictions of the OLS price model in id order, actual beside predicted."""
    res = price(spark, sf_dir)
    pred = res.linear.transform(res.split.where(F.col("split") == "test"))
    return _r(pred.orderBy("l_orderkey", "l_linenumber").limit(10)
              .select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("actual"),
                      F.col("prediction").alias("predicted")), 2)


@register("best_price_model")
def q_best_price_model(spark, sf_dir):
    """Lowest test MAE (ties → model name)."""
    best = price(spark, sf_dir).best
    return spark.createDataFrame([(best["model"], float(round(best["mae"], 4)))], "model string, mae double")


@register("best_k")
def q_best_k(spark, sf_dir):
    """The k with the highest silhouette (first k on ties) from the diagnostics table."""
    diag = q_kmeans_diagnostics(spark, sf_dir)
    return diag.orderBy(F.desc("Silhouette_Score"), "cluster").limit(1)


@register("mlp_scoring")
def q_mlp_scoring(spark, sf_dir):
    """S7/S8 + X3: the MLP bundle saved, loaded (kind checked) and applied to every raw row (>= 0.5)."""
    res = admission(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/bundles/mlp-{uuid.uuid4().hex}"
    save_bundle(spark, res.bundle, path)
    bundle = load_bundle(spark, path, "mlp")
    emb = read_table(spark, sf_dir, "embeddings")
    raw = emb.select("vec_id", *[F.col("embedding")[i].alias(f"embedding_{i}")
                                 for i in range(len(bundle.features))])
    return _r(SC.score_mlp(raw, bundle).select("vec_id", "probability_1", "predicted_class"))
