"""Model metrics: MAE, binary metrics with a decision threshold, confusion matrix,
threshold sweeps, CV score summaries and target flags.

All metrics are one aggregation over (label, prediction/probability) columns,
grouped by an optional ``split`` column so train and test come from the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mae(df: DataFrame, label: str = "label", prediction: str = "prediction",
        by: list[str] | None = None) -> DataFrame:
    by = by or []
    err = F.avg(F.abs(F.col(prediction).cast("double") - F.col(label).cast("double"))).alias("mae")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), err)


def _safe_div(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def confusion_counts(pred: Column, label: Column) -> list[Column]:
    return [
        F.count_if((label == 1) & (pred == 1)).alias("tp"),
        F.count_if((label == 0) & (pred == 1)).alias("fp"),
        F.count_if((label == 1) & (pred == 0)).alias("fn"),
        F.count_if((label == 0) & (pred == 0)).alias("tn"),
    ]


def with_rates(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall, F1 of class 1 with zero_division=0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = _safe_div(tp, tp + fp)
    recall = _safe_div(tp, tp + fn)
    return (df.withColumn("accuracy", _safe_div(tp + tn, tp + tn + fp + fn))
            .withColumn("precision", precision)
            .withColumn("recall", recall)
            .withColumn("f1", _safe_div(2 * tp, 2 * tp + fp + fn)))


def predicted_class(probability: str | Column, threshold: float = 0.5, inclusive: bool = True) -> Column:
    p = F.col(probability) if isinstance(probability, str) else probability
    return ((p >= F.lit(threshold)) if inclusive else (p > F.lit(threshold))).cast("int")


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                   by: list[str] | None = None) -> DataFrame:
    by = by or []
    counts = df.groupBy(*by).agg(*confusion_counts(F.col(prediction), F.col(label)))
    return with_rates(counts)


def threshold_sweep(df: DataFrame, thresholds: list[float], label: str = "label",
                    probability: str = "probability") -> DataFrame:
    """Metrics at every threshold in ONE pass: 4 count_if aggregates per threshold
    (no cross join with a threshold table, no row amplification)."""
    p, y = F.col(probability), F.col(label)
    aggs = []
    for i, t in enumerate(thresholds):
        pred = (p >= F.lit(t))
        aggs += [F.count_if((y == 1) & pred).alias(f"tp{i}"), F.count_if((y == 0) & pred).alias(f"fp{i}"),
                 F.count_if((y == 1) & ~pred).alias(f"fn{i}"), F.count_if((y == 0) & ~pred).alias(f"tn{i}")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"{t!r}D, tp{i}, fp{i}, fn{i}, tn{i}" for i, t in enumerate(thresholds))
    long = wide.selectExpr(f"stack({len(thresholds)}, {stack}) as (threshold, tp, fp, fn, tn)")
    return with_rates(long)


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Always 2x2: rows actual 0/1, columns pred_0 / pred_1 (one aggregation, then stack)."""
    c = df.agg(*confusion_counts(F.col(prediction), F.col(label)))
    return c.selectExpr("stack(2, 0, tn, fp, 1, fn, tp) as (actual, pred_0, pred_1)")


def score_summary(scores: DataFrame, score_col: str = "score", by: list[str] | None = None) -> DataFrame:
    """Mean and population std of per-fold scores."""
    by = by or []
    return scores.groupBy(*by).agg(F.avg(score_col).alias("mean_score"),
                                   F.stddev_pop(score_col).alias("std_score"),
                                   F.count(F.lit(1)).alias("n_folds"))


def target_flag(metric: Column, target: float, higher_is_better: bool = True) -> Column:
    return (metric >= F.lit(target)) if higher_is_better else (metric < F.lit(target))
