"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def smallest_hashes(rows: DataFrame, label: str, per_label: int, key: Column) -> DataFrame:
    """At most ``per_label`` rows of each value of ``label``, those of smallest hash of ``key``; adds ``_rank`` from 1.

    A first cut by hash keeps about twice as many rows as are wanted, so only
    a bounded number is ever sorted.  Values of ``label`` are collected: it has
    to be a class label.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    sizes = {r[label]: r["count"] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not sizes:
        return rows.withColumn("_rank", F.lit(0)).where("false")
    cut = F.create_map(*[F.lit(v) for name, n in sizes.items() for v in (name, min(1.0, 2.0 * per_label / n) * (1 << 30))])
    near = rows.withColumn("_place", place).where(F.col("_place") < F.element_at(cut, F.col(label)))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_place", key))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= per_label).drop("_place")
