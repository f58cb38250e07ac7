"""Estimators on Spark ML: OLS, logistic regression, decision tree, random forests.

Each ``fit_*`` takes a DataFrame with feature columns and a label column and
returns a ``FittedModel`` (Spark ``PipelineModel`` + feature order).  Training
is Spark ML's distributed implementation (gradient / sufficient-statistic
aggregation with treeAggregate, level-wise tree growth over binned features).

Parameter mapping from the scikit-learn originals:

* logistic, L2 with C: Spark minimises mean log-loss + λ/2‖w‖², sklearn
  minimises ½‖w‖² + C·Σ log-loss, so λ = 1/(C·n_train) with
  ``standardization=False`` (penalty on the raw coefficients);
* ``max_depth=None`` → 30 (Spark's maximum); ``min_samples_split=2`` ↔
  ``minInstancesPerNode=1``; other ``min_samples_split`` values have no exact
  counterpart there and are fitted by ``trees.fit_trees``, without a depth limit;
* ``max_features`` 'sqrt'/'log2' → an explicit integer rounded *down* like
  sklearn (Spark would round up); floats → fraction; ints → count;
* regression forests: Spark only has the variance criterion, which is also what
  ``friedman_mse`` amounts to (its gain is the drop in the sum of squares);
  ``poisson`` is fitted by ``trees.fit_trees``.  For
  ``absolute_error`` the forest is grown on variance and each leaf then
  predicts the (lower) median of its training labels instead of the
  mean — see ``LeafMedianForest``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwise.errors import PipelineError
from tabwise.functions.columns import by_position, quoted
from tabwise.operators.trees import TreeTable, fit_trees
from tabwise.session import bounded_tasks, session_conf

MAX_DEPTH = 30
# Deep trees keep each row's nodes beside the rows (checkpointed to the reliable checkpoint
# dir every 10 iterations); others walk a row down from the root, which is as fast and needs
# less than half the memory.
NODE_IDS_FROM = 13


def _tree_tuning(depth: int) -> dict:
    # more node statistics per pass over the data: fewer passes per tree level
    return {"maxMemoryInMB": 1024, "cacheNodeIds": depth >= NODE_IDS_FROM, "checkpointInterval": 10}


def _vector_bytes(n_features: int) -> int:
    """What a row takes in a fit that keeps numbers."""
    return 32 + 8 * n_features


def tree_bytes(n_features: int, n_trees: int, depth: int) -> int:
    """What a row takes in a tree fit: its bins, its weight in each tree and, in deep trees, its nodes (two versions, read with the row twice)."""
    row = 112 + 4 * n_features + 4 * n_trees
    return 2 * row + 2 * (24 + 4 * n_trees) if depth >= NODE_IDS_FROM else row


@dataclass
class FittedModel:
    """The pipeline reads its inputs under names of its own, so features may have any names.

    ``features``: names in order, or the name of one vector column.
    """

    kind: str
    pipeline: PipelineModel
    features: list[str] | str
    label: str
    params: dict = field(default_factory=dict)

    @property
    def estimator(self):
        return self.pipeline.stages[-1]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` and the model's columns; absent and NULL features count as 0.0."""
        rows, at = by_position(df)
        if isinstance(self.features, str):
            names = ["features"]
            ready = rows.withColumn("features", at[self.features])
        else:
            names = self.pipeline.stages[0].getInputCols()
            ready = rows.select("*", *[(F.coalesce(at[c].cast("double"), F.lit(0.0)) if c in at else F.lit(0.0)).alias(name)
                                       for c, name in zip(self.features, names)])
        out = self.pipeline.transform(ready).drop(*names)
        return out.toDF(*df.columns, *out.columns[len(df.columns):])


def _fit(kind: str, df: DataFrame, features: list[str] | str, label: str, est, params: dict,
         bytes_a_row: int | None = None, n_rows: int | None = None) -> FittedModel:
    """``bytes_a_row``: what a fit of several passes keeps of each row (None: nothing is, or ``df`` is bounded)."""
    rows, at = by_position(df)
    target = at[label].cast("double").alias("label")
    if isinstance(features, str):
        data = rows.select(at[features].alias("features"), target)
        data = data if bytes_a_row is None else bounded_tasks(data, bytes_a_row, n_rows)
        return FittedModel(kind, Pipeline(stages=[est]).fit(data), features, label, params)
    names = [f"_f{i}" for i in range(len(features))]
    data = rows.select(*[at[c].cast("double").alias(name) for c, name in zip(features, names)], target)
    data = data if bytes_a_row is None else bounded_tasks(data, bytes_a_row, n_rows)
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error")
    return FittedModel(kind, Pipeline(stages=[assembler, est]).fit(data), list(features), label, params)


# --------------------------------------------------------------------------- E1
def fit_linear(df: DataFrame, features: list[str], label: str) -> FittedModel:
    """Ordinary least squares via the normal equations (minimum-norm on singular designs)."""
    est = LinearRegression(featuresCol="features", labelCol="label", regParam=0.0, elasticNetParam=0.0,
                           solver="normal", standardization=False, fitIntercept=True)
    return _fit("linear_regression", df, features, label, est, {})


def coefficient_table(spark: SparkSession, model: FittedModel, features: list[str] | None = None) -> DataFrame:
    """M1: ('intercept', b) then one row per feature coefficient."""
    est = model.estimator
    names = features or model.features
    coefs = est.coefficients.toArray()
    rows = [("intercept", float(est.intercept))] + [(n, float(c)) for n, c in zip(names, coefs)]
    return spark.createDataFrame(rows, "term string, estimate double")


# --------------------------------------------------------------------------- E3
def fit_logistic(df: DataFrame, features: list[str] | str, label: str, C: float = 1.0,
                 max_iter: int = 1000, n_train: int | None = None) -> FittedModel:
    """``features``: columns, or one vector column (such as ``encoding.sparse_one_hot`` makes)."""
    n_train = n_train or df.count()
    est = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter,
                             regParam=1.0 / (C * n_train), elasticNetParam=0.0,
                             standardization=False, family="binomial", tol=1e-6)
    # of a vector column the width is not known: as for 32 numbers
    width = _vector_bytes(32 if isinstance(features, str) else len(features))
    return _fit("logistic_regression", df, features, label, est, {"C": C, "max_iter": max_iter}, width, n_train)


# --------------------------------------------------------------------------- E4 / E5
def _impurity(criterion: str) -> str:
    if criterion in ("gini",):
        return "gini"
    if criterion in ("entropy", "log_loss"):
        return "entropy"
    raise PipelineError(f"Unsupported criterion for classification: {criterion}")


def _depth(max_depth) -> int:
    if max_depth is None:
        return MAX_DEPTH
    if int(max_depth) > MAX_DEPTH:
        raise PipelineError(f"max_depth above {MAX_DEPTH} is not supported")
    return int(max_depth)


def feature_subset(max_features, n_features: int) -> str:
    if max_features in (None, "all", 1.0):
        return "all"
    if max_features == "sqrt":
        return str(max(1, int(math.sqrt(n_features))))
    if max_features == "log2":
        return str(max(1, int(math.log2(n_features))))
    if isinstance(max_features, float):
        return str(max(1, int(max_features * n_features)))
    return str(int(max_features))


def fit_decision_tree(df: DataFrame, features: list[str], label: str, criterion: str = "gini",
                      max_depth=None, min_samples_split: int = 2, max_bins: int = 64,
                      seed: int = 42) -> FittedModel | TreeTable:
    if min_samples_split != 2:
        return fit_trees(df, features, label, criterion, 1, max_depth, min_samples_split, max_bins=max_bins, seed=seed)
    depth = _depth(max_depth)
    est = DecisionTreeClassifier(featuresCol="features", labelCol="label", impurity=_impurity(criterion),
                                 maxDepth=depth, minInstancesPerNode=1, maxBins=max_bins,
                                 seed=seed, **_tree_tuning(depth))
    return _fit("decision_tree", df, features, label, est,
                {"criterion": criterion, "max_depth": max_depth, "min_samples_split": min_samples_split},
                tree_bytes(len(features), 1, depth))


def fit_random_forest(df: DataFrame, features: list[str], label: str, n_estimators: int = 100,
                      criterion: str = "gini", max_depth=None, max_features="sqrt",
                      max_bins: int = 64, seed: int = 42) -> FittedModel:
    depth = _depth(max_depth)
    est = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=n_estimators,
                                 impurity=_impurity(criterion), maxDepth=depth,
                                 featureSubsetStrategy=feature_subset(max_features, len(features)),
                                 maxBins=max_bins, seed=seed, bootstrap=True, **_tree_tuning(depth))
    return _fit("random_forest", df, features, label, est,
                {"n_estimators": n_estimators, "criterion": criterion, "max_depth": max_depth,
                 "max_features": max_features}, tree_bytes(len(features), n_estimators, depth))


def importance_table(spark: SparkSession, model: FittedModel | TreeTable) -> DataFrame:
    """M2: feature importances, descending."""
    imp = model.importances() if isinstance(model, TreeTable) else model.estimator.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(model.features, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def param_table(spark: SparkSession, model: FittedModel | TreeTable) -> DataFrame:
    """M3: the estimator's parameters as (name, value) text rows."""
    pm = model.params if isinstance(model, TreeTable) else {p.name: v for p, v in model.estimator.extractParamMap().items()}
    rows = sorted((name, str(v)) for name, v in pm.items())
    return spark.createDataFrame(rows, "param string, value string")


# --------------------------------------------------------------------------- E2
@dataclass
class LeafMedianForest:
    """Variance-grown forest whose leaves predict a median (``absolute_error`` stand-in).

    ``leaves`` has one array per tree, the value of each leaf by its number (None:
    the trees' own means).  Like the trees themselves it is model, one double a
    leaf, and goes to the tasks the same way, by broadcast; a row looks up its
    leaf of each tree in place.  Rows are neither joined nor regrouped, so ids
    are not needed and equal rows get equal predictions.
    """

    forest: FittedModel
    leaves: list[list[float]] | None

    @property
    def features(self) -> list[str]:
        return self.forest.features

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.forest.transform(df)
        if self.leaves is None:
            return scored
        lookup = leaf_mean(df.sparkSession, self.leaves)
        return scored.withColumn("prediction", lookup(vector_to_array("_leaf")))


def leaf_mean(spark: SparkSession, leaves: list[list[float]]):
    """Column function: mean over trees of ``leaves[tree][number]`` for an array of leaf numbers (NULL stays NULL)."""
    shared = spark.sparkContext.broadcast([np.asarray(values, float) for values in leaves])

    def mean_of_leaves(numbers: pa.Array) -> pa.Array:
        out = np.full(len(numbers), np.nan)
        known = numbers.is_valid().to_numpy(zero_copy_only=False)
        if known.any():
            at = numbers.flatten().to_numpy().reshape(int(known.sum()), -1).astype(np.int64)
            out[known] = sum(values[at[:, tree]] for tree, values in enumerate(shared.value)) / len(shared.value)
        return pa.array(out, mask=~known)

    mean_of_leaves = F.arrow_udf(mean_of_leaves, "double")
    return mean_of_leaves


LEAF_BUCKETS = 128      #: buckets of the label in which a leaf's rows are counted
LEAF_CELLS = 1 << 21    #: counts of a task
LEAF_MEDIAN_ACCURACY = 1000     #: percentile_approx: rank error ≤ 0.1 % of the leaf size
LEAF_ROWS = 1 << 22     #: rows, over all leaves, from which medians are picked


def fit_forest_regressor(df: DataFrame, features: list[str], label: str, n_estimators: int = 200,
                         criterion: str = "absolute_error", max_depth=None, max_features=None,
                         max_bins: int = 64, seed: int = 42, min_samples_split: int = 2,
                         id_cols: list[str] | None = None) -> LeafMedianForest | TreeTable:
    """``id_cols`` (for ``poisson`` and other ``min_samples_split``): what the bootstrap samples are drawn by."""
    if criterion not in ("absolute_error", "squared_error", "friedman_mse", "poisson"):
        raise PipelineError(f"No such regression criterion: {criterion}")
    if criterion == "poisson" or min_samples_split != 2:
        subset = feature_subset(max_features, len(features))
        return fit_trees(df, features, label, criterion, n_estimators, max_depth, min_samples_split,
                         None if subset == "all" else int(subset), id_cols, max_bins, seed=seed)
    depth = _depth(max_depth)
    est = RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=n_estimators,
                                impurity="variance", maxDepth=depth,
                                featureSubsetStrategy=feature_subset(max_features, len(features)),
                                maxBins=max_bins, seed=seed, bootstrap=True, leafCol="_leaf",
                                **_tree_tuning(depth))
    df = bounded_tasks(df, tree_bytes(len(features), n_estimators, depth))
    fitted = _fit("random_forest_regressor", df, features, label, est,
                  {"n_estimators": n_estimators, "criterion": criterion, "max_depth": max_depth})
    if criterion != "absolute_error":
        return LeafMedianForest(fitted, None)
    train = fitted.transform(df).select(quoted(label).cast("double").alias("y"), vector_to_array("_leaf").alias("leaf"))
    leaves = leaf_medians(train, [(tree.numNodes + 1) // 2 for tree in fitted.estimator.trees])
    return LeafMedianForest(fitted, leaves)


def leaf_medians(rows: DataFrame, sizes: list[int]) -> list[list[float]]:
    """The lower median ``y`` of the rows in each leaf; NaN in leaves without rows.

    ``rows``: y, and ``leaf`` with each tree's leaf number; ``sizes``: leaves by tree.
    Exact in trees whose counts fit LEAF_CELLS numbers a task; they are taken together
    as far as these fit.  In larger ones, with a rank error of at most 0.1 % of a leaf.
    """
    out: list[list[float]] = []
    while len(out) < len(sizes):
        start = len(out)
        exact = sizes[start] * LEAF_BUCKETS <= LEAF_CELLS
        end = start + 1
        while end < len(sizes) and (sizes[end] * LEAF_BUCKETS <= LEAF_CELLS) == exact and (
                not exact or sum(sizes[start:end + 1]) * LEAF_BUCKETS <= LEAF_CELLS):
            end += 1
        found = (_few_leaf_medians if exact else _many_leaf_medians)(rows, start, sizes[start:end])
        for size in sizes[start:end]:
            out.append(found[:size])
            found = found[size:]
    return out


def _many_leaf_medians(rows: DataFrame, first: int, sizes: list[int]) -> list[float]:
    """A sketch for each leaf, which keeps a leaf of very many rows small."""
    # Thousands of sketches per task would exceed the object-hash aggregate's default key limit (128) and force a sort of
    # rows × trees; keep hashing up to 64 Ki keys per task (the sort-based path still takes over beyond that, spill-safe).
    with session_conf(rows.sparkSession, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "65536"):
        per_leaf = (rows.select("y", F.posexplode(F.slice("leaf", first + 1, len(sizes))).alias("tree", "leaf"))
                    .groupBy("tree", F.col("leaf").cast("int").alias("leaf"))
                    .agg(F.percentile_approx("y", 0.5, LEAF_MEDIAN_ACCURACY).alias("value")))
        found = per_leaf.groupBy("tree").agg(F.collect_list(F.struct("leaf", "value")).alias("leaves")).collect()    # one row a tree: model
    base, medians = np.cumsum([0, *sizes[:-1]]), np.full(sum(sizes), math.nan)
    for r in found:
        for leaf in r["leaves"]:
            medians[base[r["tree"]] + leaf["leaf"]] = leaf["value"]
    return medians.tolist()


def _few_leaf_medians(rows: DataFrame, first: int, sizes: list[int]) -> list[float]:
    """Each leaf's rows are counted in buckets of the label, then in buckets of the one that holds the middle row, until
    few rows are left in all these; the middle ones are picked from them."""
    spark, groups = rows.sparkSession, sum(sizes)
    base = np.cumsum([0, *sizes[:-1]])
    rows = rows.coalesce(2 * spark.sparkContext.defaultParallelism)     # every task hands on its counts
    cuts = np.array(sorted(set(rows.approxQuantile("y", [i / LEAF_BUCKETS for i in range(1, LEAF_BUCKETS)], 1 / (8 * LEAF_BUCKETS)))))
    low, high = np.full(groups, -math.inf), np.full(groups, math.inf)       # of the bucket that holds the middle row
    want = np.zeros(groups, np.int64)                                       # its place among the rows of the bucket

    def in_buckets(batches: Iterable[pa.RecordBatch], code: bool = False) -> Iterator[tuple]:
        """(leaf, label, bucket by the cuts if ``code``) of the rows in their leaf's bucket, tree by tree."""
        for batch in batches:
            y, leaf = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            coded = np.searchsorted(cuts, y, "left") if code else None
            for tree, start in enumerate(base, first):
                group = leaf[:, tree].astype(np.int64) + start
                inside = np.flatnonzero((y >= low[group]) & (y <= high[group]) & (low[group] < high[group]))
                yield group[inside], y[inside], coded[inside] if code else None

    kind = pa.schema([("leaf", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, least, most = np.zeros(groups * LEAF_BUCKETS, np.int64), np.full(groups * LEAF_BUCKETS, math.inf), np.full(groups * LEAF_BUCKETS, -math.inf)
        for group, y, bucket in in_buckets(batches, code=not np.isfinite(low).any()):
            if bucket is None:
                bucket = np.minimum(((y - low[group]) / (high[group] - low[group]) * LEAF_BUCKETS).astype(np.int64), LEAF_BUCKETS - 1)
            at = group * LEAF_BUCKETS + bucket
            np.add.at(n, at, 1)
            np.minimum.at(least, at, y)
            np.maximum.at(most, at, y)
        for at in np.array_split(np.flatnonzero(n), max(1, np.count_nonzero(n) >> 16)):
            group, bucket = np.divmod(at.astype(np.int32), np.int32(LEAF_BUCKETS))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (group, bucket, n[at], least[at], most[at])], schema=kind)

    by_label = Window.partitionBy("leaf").orderBy("bucket")
    while True:
        wanted = spark.createDataFrame(pa.table({"leaf": np.arange(groups, dtype=np.int32), "want": want}))
        cells = (rows.mapInArrow(count, "leaf int, bucket int, n bigint, low double, high double")
                 .groupBy("leaf", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
                 .withColumn("upto", F.sum("n").over(by_label)).withColumn("all", F.sum("n").over(Window.partitionBy("leaf")))
                 .join(F.broadcast(wanted), "leaf")
                 .withColumn("want", F.when(F.col("want") > 0, F.col("want")).otherwise(F.expr("(all + 1) div 2")))
                 .where("upto >= want AND upto - n < want"))
        found = cells.select("leaf", "n", "low", "high", (F.col("want") - (F.col("upto") - F.col("n"))).alias("want")).collect()   # one row a leaf
        for r in found:
            low[r["leaf"]], high[r["leaf"]], want[r["leaf"]] = r["low"], r["high"], r["want"]
        # leaves without rows, and those whose bucket has one value, are done
        empty = ~np.isfinite(low)
        high[empty] = low[empty]
        left = sum(r["n"] for r in found if r["low"] < r["high"])
        if left <= LEAF_ROWS:
            break

    picked = pa.schema([("leaf", pa.int32()), ("y", pa.float64())])

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, y, _ in in_buckets(batches):
            yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(y)], schema=picked)

    medians = np.where(np.isfinite(low), low, math.nan)
    if left:
        wanted = spark.createDataFrame(pa.table({"leaf": np.arange(groups, dtype=np.int32), "want": want}))
        ranked = (rows.mapInArrow(pick, "leaf int, y double").groupBy("leaf", "y").agg(F.count(F.lit(1)).alias("n"))
                  .withColumn("upto", F.sum("n").over(Window.partitionBy("leaf").orderBy("y"))).join(F.broadcast(wanted), "leaf"))
        for r in ranked.where("upto >= want").groupBy("leaf").agg(F.min("y").alias("y")).collect():     # one row a leaf
            medians[r["leaf"]] = r["y"]
    return medians.tolist()
