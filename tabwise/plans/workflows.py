"""The four end-to-end workflows, as configurable compositions of operators.

* ``classification_workflow`` — impute → one-hot → validated Y/N target →
  exact stratified split → train-only min-max → logistic / tree / forest →
  thresholded metrics, confusion matrices, comparison, cross-validation,
  defaults and a saved bundle (eligibility).
* ``regression_workflow`` — numeric table → split (optionally stratified on a
  0/1 column) → OLS and a (leaf-median) forest → train/test MAE (price).
* ``segmentation_workflow`` — coerce/reject → correlations → K-means with
  restarts → diagnostics over k → profiles → segment names (customers).
* ``mlp_workflow`` — coerce/reject → threshold target → one-hot → split →
  scale → MLP → train/test metrics, loss curve, layers (admission).

Column names are arguments; nothing is tied to one dataset.  Intermediate
tables that several later steps read are cut with a reliable checkpoint.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.errors import PipelineError
from tabwise.functions.columns import quoted
from tabwise.operators import cluster as CL
from tabwise.operators import correlation as CO
from tabwise.operators import metrics as ME
from tabwise.operators import models as MO
from tabwise.operators import mlp as MLP
from tabwise.operators import prep as PR
from tabwise.operators import split as SP
from tabwise.operators import tuning as TU
from tabwise.operators.trees import TreeTable
from tabwise.operators.quantiles import exact_quantiles, modes
from tabwise.session import deal_out, ensure_parallelism, fits_at_once, materialize, persist_balanced
from tabwise.sources.models_io import Bundle
from tabwise.sources.validate import coerce_and_reject, require_columns, require_numeric


# =============================================================================== classification
@dataclass
class ClassificationConfig:
    id_col: str
    target: str
    mapping: dict = field(default_factory=lambda: {"Y": 1, "N": 0})
    mode_cols: list = field(default_factory=list)
    median_cols: list = field(default_factory=list)
    categorical_cols: list = field(default_factory=list)
    numeric_cols: list = field(default_factory=list)
    test_size: float = 0.2
    seed: int = 42
    threshold: float = 0.5
    logistic_C: float = 1.0
    logistic_max_iter: int = 1000
    tree_criterion: str = "gini"
    tree_max_depth: int | None = None
    tree_min_samples_split: int = 2
    forest_trees: int = 100
    forest_criterion: str = "gini"
    forest_max_depth: int | None = None
    forest_max_features: object = "sqrt"
    cv_folds: int = 5
    cv_stratified: bool = False
    cv_shuffle: bool = True                               # False: the notebooks' unshuffled KFold
    cv_model: str = "logistic"
    fill_constants: dict = field(default_factory=dict)   # P8: e.g. {"Gender": "Male"} before imputation


@dataclass
class ClassificationResult:
    features: list
    split: DataFrame
    scaler: PR.MinMaxModel
    models: dict
    metrics: DataFrame
    confusion: dict
    comparison: DataFrame
    cv_scores: DataFrame | None
    defaults: dict
    bundle: Bundle


def _scored_class(model: MO.FittedModel, df: DataFrame, threshold: float, use_probability: bool) -> DataFrame:
    out = model.transform(df)
    prob = vector_to_array("probability")[1]
    out = out.withColumn("p1", prob)
    if use_probability:
        return out.withColumn("prediction", ME.predicted_class("p1", threshold))
    return out.withColumn("prediction", F.col("prediction").cast("int"))


def _inner_names(columns: list[str], shown: dict) -> list[str]:
    """Names that any table can hold in place of the features' own (which may have dots or differ only in case)."""
    inner = {c: name for name, c in shown.items()}
    return [inner.get(c, c) for c in columns]


def default_raw_values(df: DataFrame, categorical: list[str], numeric: list[str]) -> dict:
    """Mode per category, exact median per number."""
    found = modes(df, categorical) if categorical else {}
    out = {c: (found[c] or (None,))[0] for c in categorical}
    if numeric:
        med = exact_quantiles(df.select(*[quoted(c).cast("double").alias(c) for c in numeric]), numeric, [0.5])
        out.update({c: med[c][0] for c in numeric})
    return out


def classification_workflow(spark: SparkSession, df: DataFrame, cfg: ClassificationConfig,
                            models=("logistic", "decision_tree", "random_forest")) -> ClassificationResult:
    require_columns(df, [cfg.id_col, cfg.target, *cfg.mode_cols, *cfg.median_cols, *cfg.categorical_cols])
    # Statistics, categories and the split each read the input: persist it once
    # (spills to disk when large) instead of recomputing upstream joins per pass.
    if cfg.fill_constants:  # notebook variant: a constant fill before the statistics
        df = df.fillna(cfg.fill_constants)
    df = persist_balanced(df)
    # One mode job and one quantile refinement serve both the imputation (T1) and the
    # default raw values (A26): filling NULLs with the mode/median leaves both unchanged.
    mode_cols = list(dict.fromkeys([*cfg.mode_cols, *cfg.categorical_cols]))
    median_cols = list(dict.fromkeys([*cfg.median_cols, *cfg.numeric_cols]))
    found = modes(df, mode_cols) if mode_cols else {}
    meds = exact_quantiles(df.select(*[quoted(c).cast("double").alias(c) for c in median_cols]),
                           median_cols, [0.5]) if median_cols else {}
    stats = PR.ImputeStats()
    for c in cfg.mode_cols:
        if found[c] is None:
            raise PipelineError(f"Cannot calculate a mode for `{c}`.")
        stats.values[c], stats.kinds[c] = found[c][0], "mode"
    for c in cfg.median_cols:
        if meds[c][0] is None:
            raise PipelineError(f"Cannot calculate the median for `{c}`.")
        stats.values[c], stats.kinds[c] = meds[c][0], "median"
    imputed = PR.apply_impute(df, stats)
    defaults = {c: (found[c] or (None,))[0] for c in cfg.categorical_cols}
    defaults.update({c: meds[c][0] for c in cfg.numeric_cols})
    encoded, onehot = PR.one_hot(imputed, cfg.categorical_cols)
    labelled = PR.map_target(encoded, cfg.target, cfg.mapping, "label").drop(cfg.target)
    features = [c for c in labelled.columns if c not in (cfg.id_col, "label")]
    shown = dict(zip((f"_f{i}" for i in range(len(features))), features))
    labelled = labelled.toDF(*_inner_names(labelled.columns, shown))
    features = list(shown)
    sp = SP.train_test_split(labelled, cfg.id_col, "label", cfg.test_size, cfg.seed)
    sp = materialize(sp)
    df.unpersist()
    train = sp.where(F.col("split") == "train")
    scaler = PR.fit_minmax(train, features)
    scaled = PR.apply_minmax(sp, scaler)
    n_train = train.count()
    # every pass of every fit reads these rows: dealt out and kept once
    width = MO.tree_bytes(len(features), cfg.forest_trees, MO._depth(cfg.forest_max_depth))
    s_train = deal_out(scaled.where(F.col("split") == "train"), width, n_train).persist(StorageLevel.MEMORY_AND_DISK)
    s_train.count()

    builders = {
        "logistic": lambda: MO.fit_logistic(s_train, features, "label", cfg.logistic_C,
                                            cfg.logistic_max_iter, n_train),
        "decision_tree": lambda: MO.fit_decision_tree(s_train, features, "label", cfg.tree_criterion,
                                                      cfg.tree_max_depth, cfg.tree_min_samples_split, seed=cfg.seed),
        "random_forest": lambda: MO.fit_random_forest(s_train, features, "label", cfg.forest_trees,
                                                      cfg.forest_criterion, cfg.forest_max_depth,
                                                      cfg.forest_max_features, seed=cfg.seed),
    }
    wanted = [m for m in builders if m in models]
    # The three estimators are independent: fit them as concurrent Spark jobs, unless each fills the cluster.
    with ThreadPoolExecutor(max_workers=fits_at_once(spark, n_train, TU.FIT_BYTES, len(wanted) or 1)) as pool:
        fitted = dict(zip(wanted, pool.map(lambda m: builders[m](), wanted)))
    def evaluate(name):
        # The decision slider applies to the logistic model; trees use 0.5.
        thr = cfg.threshold if name == "logistic" else 0.5
        scored = _scored_class(fitted[name], scaled, thr, True)
        m = ME.binary_metrics(scored, "label", "prediction", ["split"]).withColumn("threshold", F.lit(thr))
        m = m.persist()
        m.count()
        return m, ME.confusion_matrix(scored.where(F.col("split") == "test"), "label", "prediction")

    with ThreadPoolExecutor(max_workers=len(fitted) or 1) as pool:
        evaluated = dict(zip(fitted, pool.map(evaluate, list(fitted))))
    tables = {k: v[0] for k, v in evaluated.items()}
    confusion = {k: v[1] for k, v in evaluated.items()}
    metrics = TU.comparison_table(tables, "accuracy")
    comparison = metrics.where(F.col("split") == "test").orderBy(F.desc("accuracy"), "model")

    cv_scores = None
    if cfg.cv_folds and cfg.cv_model in fitted:
        name = cfg.cv_model

        def fit(part):
            if name == "logistic":
                return MO.fit_logistic(part, features, "label", cfg.logistic_C, cfg.logistic_max_iter)
            if name == "decision_tree":
                return MO.fit_decision_tree(part, features, "label", cfg.tree_criterion, cfg.tree_max_depth,
                                            cfg.tree_min_samples_split, seed=cfg.seed)
            return MO.fit_random_forest(part, features, "label", cfg.forest_trees, cfg.forest_criterion,
                                        cfg.forest_max_depth, cfg.forest_max_features, seed=cfg.seed)

        def predict(model, part):
            return _scored_class(model, part, 0.5, False)

        cv_scores = TU.cross_validate(spark, s_train.drop("split"), cfg.id_col, "label", fit, predict,
                                      cfg.cv_folds, cfg.cv_stratified, cfg.seed, shuffle=cfg.cv_shuffle)
    s_train.unpersist()
    # From here on, the features have their own names again.
    features = list(shown.values())
    sp, scaler = sp.toDF(*[shown.get(c, c) for c in sp.columns]), scaler.renamed(shown)
    for model in fitted.values():
        model.features = features
    best = "logistic" if "logistic" in fitted else next(iter(fitted))
    bundle = Bundle("classification", features,
                    {"model_name": best, "defaults": defaults, "categories": onehot.categories,
                     "mins": scaler.mins, "maxs": scaler.maxs, "threshold": 0.5,
                     "categorical": cfg.categorical_cols, "numeric": cfg.numeric_cols})
    if isinstance(fitted[best], TreeTable):
        bundle.trees = fitted[best]
    else:
        bundle.spark_model = fitted[best].pipeline
    return ClassificationResult(features, sp, scaler, fitted, metrics, confusion, comparison, cv_scores,
                                defaults, bundle)


# =============================================================================== regression
@dataclass
class RegressionResult:
    features: list
    stratify_used: str | None
    linear: MO.FittedModel
    forest: MO.LeafMedianForest | TreeTable | None
    mae: DataFrame
    comparison: DataFrame
    best: object
    split: DataFrame
    bundles: dict        # by model name


def regression_workflow(spark: SparkSession, df: DataFrame, id_col, target: str = "price",
                        stratify_col: str | None = "property_type_Condo", use_stratify: bool = True,
                        test_size: float = 0.2, seed: int = 42, n_estimators: int = 200,
                        criterion: str = "absolute_error", max_depth=None, with_forest: bool = True,
                        min_samples_split: int = 2) -> RegressionResult:
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    require_columns(df, [target, *ids])
    require_numeric(df)
    strat = stratify_col if (use_stratify and stratify_col in df.columns) else None
    sp = materialize(SP.train_test_split(df, ids, strat, test_size, seed))
    features = [c for c in df.columns if c not in (target, *ids)]
    train = sp.where(F.col("split") == "train")
    if with_forest:     # every pass of the forest reads these rows: dealt out and kept once
        width = MO.tree_bytes(len(features), n_estimators, MO._depth(max_depth))
        train = deal_out(train, width, train.count()).persist(StorageLevel.MEMORY_AND_DISK)
    linear = MO.fit_linear(train, features, target)

    def errors(model) -> DataFrame:     # two rows, kept: the choice of the best model and every reader would score all rows again
        kept = ME.mae(model.transform(sp).withColumn("label", F.col(target)), "label", "prediction", ["split"]).persist()
        kept.count()
        return kept

    tables = {"linear_regression": errors(linear)}
    forest = None
    if with_forest:
        forest = MO.fit_forest_regressor(train, features, target, n_estimators, criterion, max_depth, seed=seed,
                                         min_samples_split=min_samples_split, id_cols=ids)
        tables["random_forest"] = errors(forest)
        train.unpersist()
    mae = TU.comparison_table(tables, "mae", descending=False)
    comparison = mae.where(F.col("split") == "test").orderBy("mae", "model")
    best = TU.best_model(comparison, "mae", maximise=False)
    extras = {"target": target, "stratify_used": strat}
    bundles = {"linear_regression": Bundle("price", features, {"model_name": "linear_regression", **extras}, linear.pipeline)}
    if isinstance(forest, TreeTable):
        bundles["random_forest"] = Bundle("price", features, {"model_name": "random_forest", **extras}, trees=forest)
    elif forest is not None:
        bundles["random_forest"] = Bundle("price", features, {"model_name": "random_forest", **extras},
                                          forest.forest.pipeline, forest.leaves)
    return RegressionResult(features, strat, linear, forest, mae, comparison, best, sp, bundles)


# =============================================================================== segmentation
@dataclass
class SegmentationResult:
    model: CL.KMeansResult
    clustered: DataFrame
    diagnostics: DataFrame | None
    profile: DataFrame
    names: DataFrame
    named: DataFrame
    pearson: DataFrame
    spearman: DataFrame
    bundle: Bundle


def segmentation_workflow(spark: SparkSession, df: DataFrame, id_col: str, features: list[str], k: int,
                          profile_means: dict, share: tuple | None, income_col: str, spend_col: str,
                          k_values=None, init: str = "k-means++", n_init: int = 10, max_iter: int = 300,
                          seed: int = 42) -> SegmentationResult:
    require_columns(df, [id_col, *features])
    data = ensure_parallelism(coerce_and_reject(df, features)).persist()
    pearson = CO.pearson_matrix(data, features)
    spearman = CO.spearman_matrix(data, features)
    result = CL.fit_kmeans(data, features, k, init, n_init, max_iter, seed=seed)
    clustered = CL.predict_clusters(result, data, "Cluster")
    diagnostics = CL.cluster_diagnostics(data, features, k_values, init, n_init, max_iter, seed) \
        if k_values else None
    # k rows, written once: medians, names and the lookup read these, not the customers again
    profile = materialize(CL.cluster_profile(clustered, "Cluster", id_col, profile_means, share), spread=False)
    names = CL.segment_names(profile, "Cluster", income_col, spend_col)
    named = CL.attach_segments(clustered, names, "Cluster")
    bundle = Bundle("kmeans", list(features), {"centres": result.centres(), "k": k})
    return SegmentationResult(result, clustered, diagnostics, profile, names, named, pearson, spearman, bundle)


# =============================================================================== MLP
@dataclass
class MLPResult:
    model: MLP.MLPModel
    features: list
    scaler: PR.MinMaxModel
    metrics: DataFrame
    confusion: DataFrame
    loss: DataFrame
    layers: DataFrame
    bundle: Bundle


def mlp_workflow(spark: SparkSession, df: DataFrame, id_col: str, target: str, raw_features: list[str],
                 categorical: list[str], threshold: float = 0.8, test_size: float = 0.2, seed: int = 123,
                 hidden=(3, 4), activation: str = "relu", batch_size: int = 50, learning_rate: float = 1e-3,
                 alpha: float = 1e-4, max_iter: int = 200, early_stopping: bool = False,
                 vector_col: str | None = None) -> MLPResult:
    """``vector_col`` may name an array<float|double> column used as extra numeric inputs."""
    required = [id_col, target, *raw_features]
    require_columns(df, required + ([vector_col] if vector_col else []))
    data = coerce_and_reject(df, [target, *raw_features])
    data = (PR.threshold_class(data, target, threshold, "_class").drop(target)
            .withColumnRenamed("_class", "label"))
    for c in categorical:  # integer categories keep their integer spelling in dummy names
        data = data.withColumn(c, F.col(c).cast("long"))
    encoded, onehot = PR.one_hot(data, categorical)
    if vector_col:
        dim = encoded.select(F.size(vector_col)).first()[0]
        encoded = encoded.select("*", *[F.col(vector_col)[i].cast("double").alias(f"{vector_col}_{i}")
                                        for i in range(dim)]).drop(vector_col)
    features = [c for c in encoded.columns if c not in (id_col, "label")]
    if not features:
        raise PipelineError("No features left to train on")
    shown = dict(zip((f"_f{i}" for i in range(len(features))), features))
    encoded = encoded.toDF(*_inner_names(encoded.columns, shown))
    sp = materialize(SP.train_test_split(encoded, id_col, "label", test_size, seed))
    features = list(shown)
    scaler = PR.fit_minmax(sp.where(F.col("split") == "train"), features)
    scaled = PR.apply_minmax(sp, scaler).select(id_col, "label", "split",
                                                F.array(*[quoted(c) for c in features]).alias("x"))
    model = MLP.fit_mlp(scaled.where(F.col("split") == "train"), "x", "label", hidden, activation,
                        batch_size, learning_rate, alpha, max_iter, early_stopping=early_stopping,
                        seed=seed, id_col=id_col)
    scored = MLP.predict_mlp(scaled, model, "x")
    metrics = ME.binary_metrics(scored, "label", "prediction", ["split"])
    confusion = ME.confusion_matrix(scored.where(F.col("split") == "test"), "label", "prediction")
    features, scaler = list(shown.values()), scaler.renamed(shown)
    bundle = Bundle("mlp", features, {"theta": model.theta, "hidden": list(hidden), "activation": activation,
                                      "mins": scaler.mins, "maxs": scaler.maxs, "threshold": threshold,
                                      "categories": onehot.categories})
    return MLPResult(model, features, scaler, metrics, confusion, MLP.loss_table(spark, model),
                     model.layer_table(spark), bundle)
