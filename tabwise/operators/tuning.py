"""Cross-validation (E8), hyperparameter trials (E9) and model comparison (M7).

Folds come from ``split.kfold_ids`` / ``stratified_kfold_ids`` (exact sizes,
seeded md5 order).  Every fold is an ordinary distributed fit on the rows of
the other folds, scored on the held-out fold; the per-fold scores form a small
table summarised by mean and population std (A25).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.operators import metrics as ME
from tabwise.operators.split import kfold_ids, stratified_kfold_ids
from tabwise.session import deal_out, fits_at_once

#: What a fit of unknown kind keeps of a row.
FIT_BYTES = 512


def accuracy_of(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    v = scored.agg(F.avg((F.col(prediction).cast("double") == F.col(label).cast("double")).cast("double"))).first()[0]
    return float(v) if v is not None else 0.0


def assign_folds(df: DataFrame, id_col: str, label: str, folds: int = 5, stratified: bool = False,
                 seed: int = 42, shuffle: bool = True) -> DataFrame:
    """Fold ids (exact sizes), persisted because every fold and configuration reads them.
    ``shuffle=False`` gives the unshuffled KFold of the notebooks (folds in id order)."""
    assigned = (stratified_kfold_ids(df, id_col, label, folds, seed) if stratified
                else kfold_ids(df, id_col, folds, seed, shuffle=shuffle))
    return deal_out(assigned, FIT_BYTES, df.count()).persist(StorageLevel.MEMORY_AND_DISK)


def _at_once(spark: SparkSession, rows: int, parallelism: int) -> int:
    return fits_at_once(spark, rows, FIT_BYTES, max(1, parallelism))


def _fold_sizes(assigned: DataFrame) -> dict[int, int]:
    """Rows of each fold; this also fills the cache before several fits ask for it at once."""
    return {r["fold"]: r["count"] for r in assigned.groupBy("fold").count().collect()}      # one row a fold


def _run_folds(spark, assigned: DataFrame, sizes: dict[int, int], label: str, fit, predict, folds: int, parallelism: int):
    n = sum(sizes.values())

    def one(f: int):
        train = assigned.where(F.col("fold") != f)
        test = assigned.where(F.col("fold") == f)
        model = fit(train)
        scored = predict(model, test)
        return (f, n - sizes.get(f, 0), sizes.get(f, 0), accuracy_of(scored, label))

    # Independent fits run as concurrent Spark jobs (like CrossValidator's parallelism):
    # small fits leave most of the cluster idle, so overlapping them cuts wall time.
    with ThreadPoolExecutor(max_workers=_at_once(spark, n, parallelism)) as pool:
        rows = list(pool.map(one, range(folds)))
    return spark.createDataFrame(rows, "fold int, n_train bigint, n_test bigint, score double")


def cross_validate(spark: SparkSession, df: DataFrame, id_col: str, label: str,
                   fit: Callable[[DataFrame], object], predict: Callable[[object, DataFrame], DataFrame],
                   folds: int = 5, stratified: bool = False, seed: int = 42,
                   parallelism: int = 4, shuffle: bool = True) -> DataFrame:
    """Per-fold accuracy table (fold, n_train, n_test, score)."""
    assigned = assign_folds(df, id_col, label, folds, stratified, seed, shuffle)
    out = _run_folds(spark, assigned, _fold_sizes(assigned), label, fit, predict, folds, parallelism)
    out = out.persist()
    out.count()
    assigned.unpersist()
    return out


def cross_validate_models(spark: SparkSession, df: DataFrame, id_col: str, label: str,
                          fits: dict[str, Callable[[DataFrame], object]],
                          predict: Callable[[object, DataFrame], DataFrame], folds: int = 5,
                          stratified: bool = False, seed: int = 42, parallelism: int = 4,
                          shuffle: bool = True) -> DataFrame:
    """Per-fold accuracy of several models on the same folds: (model, fold, n_train, n_test, score)."""
    assigned = assign_folds(df, id_col, label, folds, stratified, seed, shuffle)
    sizes = _fold_sizes(assigned)
    tables = {name: _run_folds(spark, assigned, sizes, label, fit, predict, folds, parallelism) for name, fit in fits.items()}
    assigned.unpersist()
    parts = [t.select(F.lit(name).alias("model"), "*") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def cv_summary(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A25 + F10: mean, population std and the fold scores joined as text, one aggregation (for each ``by``, if given)."""
    ordered = F.array_sort(F.collect_list(F.struct("fold", "score")))
    return scores.groupBy(*(by or [])).agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"),
                      F.count(F.lit(1)).alias("n_folds"),
                      F.array_join(F.transform(ordered, lambda x: F.format_number(x["score"], 4)), ", ")
                      .alias("scores"))


def parameter_trials(spark: SparkSession, df: DataFrame, id_col: str, label: str,
                     grid: list[dict], make_fit: Callable[[dict], Callable], predict: Callable,
                     folds: int = 5, stratified: bool = True, seed: int = 42,
                     parallelism: int = 4) -> DataFrame:
    """One CV run per configuration on ONE shared fold assignment → (config, mean, std)."""
    assigned = assign_folds(df, id_col, label, folds, stratified, seed)
    sizes = _fold_sizes(assigned)

    def one(cfg):
        scores = _run_folds(spark, assigned, sizes, label, make_fit(cfg), predict, folds, 1)
        row = ME.score_summary(scores, "score").first()
        return (str(sorted(cfg.items())), float(row["mean_score"]), float(row["std_score"]))

    with ThreadPoolExecutor(max_workers=_at_once(spark, sum(sizes.values()), parallelism)) as pool:
        out = list(pool.map(one, grid))
    assigned.unpersist()
    return (spark.createDataFrame(out, "config string, mean_score double, std_score double")
            .orderBy(F.desc("mean_score")))


def comparison_table(tables: dict[str, DataFrame], sort_col: str, descending: bool = True) -> DataFrame:
    """M7: union metric rows of several models (U1), sorted (L4)."""
    parts = [t.withColumn("model", F.lit(name)) for name, t in tables.items()]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    order = F.desc(sort_col) if descending else F.asc(sort_col)
    return union.orderBy(order, "model")


def best_model(table: DataFrame, metric: str, maximise: bool = True):
    """Top-1 by metric (ties → model name), one distributed top-k."""
    order = F.desc(metric) if maximise else F.asc(metric)
    return table.orderBy(order, "model").limit(1).first()
