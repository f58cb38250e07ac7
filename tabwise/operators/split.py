"""Exact-size train/test splits and k-fold assignments (stratified or not).

Sizes follow the usual ``train_test_split`` contract: ``n_test = ceil(test_size*n)``,
``n_train = n - n_test``; with a stratum, each class receives
``floor(n_train*count/n)`` training rows plus one extra for the classes with the
largest remainders (ties: smaller class value first — deterministic where the
NumPy original is random).  Which rows go where is decided by the seeded md5
order of the id (see ``ranking``), so Spark and any SQL engine agree exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.errors import PipelineError
from tabwise.operators.ranking import ordered_totals, rank_segments
from tabwise.session import materialize


def class_counts(df: DataFrame, label_col: str) -> DataFrame:
    """(label, n) of every class, NULL included, as a written table."""
    return materialize(df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")), spread=False)


def train_quotas(counts: list[tuple], n_train: int) -> dict:
    """Largest-remainder allocation of ``n_train`` rows over a list of classes: the rule of ``quota_table``."""
    n = sum(c for _, c in counts)
    base = {k: (c * n_train) // n for k, c in counts}
    rema = sorted(((-((c * n_train) % n), i, k) for i, (k, c) in enumerate(counts)))
    left = n_train - sum(base.values())
    for _, _, k in rema[:left]:
        base[k] += 1
    return base


def quota_table(counts: DataFrame, label_col: str, n: int, n_train: int) -> DataFrame:
    """(label, n, train): ``train_quotas`` as a table, for any number of classes."""
    product = f"(CAST(n AS DECIMAL(19,0)) * CAST({n_train} AS DECIMAL(19,0)))"
    shares = counts.select(label_col, "n", F.expr(f"CAST({product} div {n} AS BIGINT)").alias("_whole"),
                           F.expr(f"CAST({product} % {n} AS BIGINT)").alias("_rest"))
    left = n_train - shares.agg(F.sum("_whole")).first()[0]
    ranked = ordered_totals(shares, [F.desc("_rest"), F.asc_nulls_last(label_col)], F.lit(1), "_place")
    return ranked.select(label_col, "n", (F.col("_whole") + (F.col("_place") < left).cast("int")).alias("train"))


def split_sizes(n: int, test_size: float) -> tuple[int, int]:
    if isinstance(test_size, float) and 0 < test_size < 1:
        n_test = math.ceil(test_size * n)
    else:
        n_test = int(test_size)
    n_train = n - n_test
    if n_test <= 0 or n_train <= 0:
        raise PipelineError(f"test_size={test_size} leaves an empty side for {n} rows")
    return n_train, n_test


def train_test_split(df: DataFrame, id_cols: list[str] | str, stratify: str | None = None,
                     test_size: float = 0.2, seed: int = 42, split_col: str = "split") -> DataFrame:
    """Add ``split_col`` ∈ {'train','test'} with exact sizes and class quotas.

    Cost: the class counts, and the order key of each class's last test row (see
    ``rank_segments``); rows are then assigned in a projection.
    """
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    if stratify is None:
        n = df.count()
        _, n_test = split_sizes(n, test_size)
        seg = rank_segments(df, id_cols, seed, {None: [n_test]}, n=n)
        return (seg.withColumn(split_col, F.when(F.col("_seg") == 0, F.lit("test")).otherwise(F.lit("train")))
                .drop("_seg"))
    else:
        counts = class_counts(df, stratify)
        n = counts.agg(F.sum("n")).first()[0] or 0
        n_train, _ = split_sizes(n, test_size)
        small = counts.where("n < 2").orderBy(F.asc_nulls_last(stratify)).limit(10).collect()
        if small:
            raise PipelineError(f"Stratified splitting on `{stratify}` needs two rows or more in each class; "
                                f"too few in (first ten): {[r[0] for r in small]}")
        quotas = quota_table(counts, stratify, n, n_train)
        seg = rank_segments(df, id_cols, seed, quotas.withColumn("cuts", F.array(F.col("n") - F.col("train"))), stratify)
    return (seg.withColumn(split_col, F.when(F.col("_seg") == 0, F.lit("test")).otherwise(F.lit("train")))
            .drop("_seg"))


def kfold_ids(df: DataFrame, id_cols: list[str] | str, k: int = 5, seed: int = 42,
              shuffle: bool = True, fold_col: str = "fold") -> DataFrame:
    """``KFold``: fold sizes differ by at most one, the first ``n % k`` folds larger.

    ``shuffle=True`` ranks rows in the seeded md5 order; ``shuffle=False`` ranks
    them in id order (range partitioning + per-partition offsets, see ``_id_rank``).
    """
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    n = df.count()
    if k < 2 or k > n:
        raise PipelineError(f"Cannot make {k} folds from {n} rows")
    q, rem = divmod(n, k)
    if shuffle:
        sizes = [q + 1 if f < rem else q for f in range(k)]
        cuts = [sum(sizes[:f + 1]) for f in range(k - 1)]
        seg = rank_segments(df, id_cols, seed, {None: cuts}, n=n)
        return seg.withColumn(fold_col, F.col("_seg").cast("int")).drop("_seg")
    ranked = _id_rank(df, id_cols)
    r = F.col("_rank")
    fold = F.when(r < F.lit(rem * (q + 1)), F.floor(r / F.lit(q + 1))) \
        .otherwise(F.lit(rem) + F.floor((r - F.lit(rem * (q + 1))) / F.lit(q)))
    return ranked.withColumn(fold_col, fold.cast("int")).drop("_rank")


def fold_cuts(counts: DataFrame, label_col: str, k: int) -> DataFrame:
    """(label, n, cuts): the rank cuts of each class when the label-sorted sequence is dealt round-robin.

    Class c occupies positions [o_c, o_c + n_c) of the label-sorted sequence and
    fold f receives the positions p ≡ f (mod k): that fixes how many rows of c
    each fold gets (overall fold sizes then differ by at most one).
    """
    placed = ordered_totals(counts, [F.asc_nulls_last(label_col)], F.col("n"), "_from")
    dealt = lambda x, f: f"(({x}) div {k}) * {f + 1} + least(({x}) % {k}, {f + 1})"  # noqa: E731  to folds 0 to f
    cuts = [F.expr(f"{dealt('_from + n', f)} - ({dealt('_from', f)})").cast("long") for f in range(k - 1)]
    return placed.select(label_col, "n", F.array(*cuts).alias("cuts"))


def stratified_kfold_ids(df: DataFrame, id_cols: list[str] | str, label_col: str, k: int = 5,
                         seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """``StratifiedKFold``: per-class fold counts of the round-robin allocation; within a
    class the rows (in seeded md5 order) fill fold 0, then fold 1, … — a random
    assignment with exact counts, and exactly the unshuffled rule in id order."""
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    seg = rank_segments(df, id_cols, seed, fold_cuts(class_counts(df, label_col), label_col, k), label_col)
    return seg.withColumn(fold_col, F.col("_seg").cast("int")).drop("_seg")


def _id_rank(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """Exact rank in id order (unshuffled folds): range partitioning + partition offsets."""
    return ordered_totals(df, [F.col(c) for c in id_cols], F.lit(1), "_rank")
