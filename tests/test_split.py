import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabwise.errors import PipelineError
from tabwise.operators.ranking import hash_key, rank_segments
from tabwise.operators.split import (kfold_ids, stratified_kfold_ids, train_quotas,
                                     train_test_split)


def _frame(spark, n=1000, classes=(0, 1, 2), weights=(0.6, 0.3, 0.1)):
    rows = []
    cuts = [round(n * sum(weights[:i + 1])) for i in range(len(weights))]
    for i in range(n):
        k = next(c for c, cut in zip(classes, cuts) if i < cut)
        rows.append((i, k))
    return spark.createDataFrame(rows, "id long, y int")


@pytest.mark.parametrize("rows_per_bucket", [1 << 20, 16])
def test_segments_match_global_window(spark, rows_per_bucket):
    df = _frame(spark, 700)
    got = rank_segments(df, ["id"], 42, {0: [0, 100], 1: [7, 8], 2: [35, 70]}, "y", rows_per_bucket=rows_per_bucket)
    w = Window.partitionBy("y").orderBy(hash_key(["id"], 42), "id")
    cut = {0: (0, 100), 1: (7, 8), 2: (35, 70)}
    rows = got.join(df.withColumn("r", F.row_number().over(w) - 1), ["id", "y"]).collect()
    assert len(rows) == 700
    assert all(row["_seg"] == sum(row["r"] >= c for c in cut[row["y"]]) for row in rows)


def _tied(spark, parts):
    """Ids of 1 to 400 rows, wholly equal rows, null ids and classes, a null and a NaN among the other columns."""
    rows = [(k % 7, k % 3, float(k % 5)) for k in range(60)] + [(100, 0, 1.0)] * 400 + [(None, 1, None)] * 9
    rows += [(200 + k, None, float("nan")) for k in range(20)]
    return spark.createDataFrame(rows, "id long, y int, x double").repartition(parts)


@pytest.mark.parametrize("parts", [1, 4, 211])
def test_sizes_are_exact_with_equal_ids_and_rows(spark, parts):
    df = _tied(spark, parts)
    n = 489
    for size in (0.2, 0.85):
        sp = train_test_split(df, "id", None, size, 3)
        assert sp.where("split = 'test'").count() == math.ceil(size * n) and sp.count() == n
    sp = train_test_split(df, "id", "y", 0.3, 3)
    got = {(r["y"], r["split"]): r["count"] for r in sp.groupBy("y", "split").count().collect()}
    sizes = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    quotas = train_quotas(sorted(sizes.items(), key=lambda x: (x[0] is None, x[0])), n - math.ceil(0.3 * n))
    assert got == {(k, s): v for k in sizes for s, v in (("train", quotas[k]), ("test", sizes[k] - quotas[k])) if v}
    folds = [r["count"] for r in kfold_ids(df, "id", 5, 3).groupBy("fold").count().orderBy("fold").collect()]
    assert folds == [98, 98, 98, 98, 97]
    folds = [r["count"] for r in stratified_kfold_ids(df, "id", "y", 5, 3).groupBy("fold").count().orderBy("fold").collect()]
    assert sorted(folds) == [97, 98, 98, 98, 98]
    assert sorted(map(str, sp.select("id", "y", "x").collect())) == sorted(map(str, df.collect()))


def test_equal_ids_are_split_by_their_other_columns(spark):
    """The same rows on each side, whatever the partitions are; ten equal ids have test rows and even folds."""
    df = spark.createDataFrame([(1, k) for k in range(10)], "id long, x int")
    sides = [sorted(r["x"] for r in train_test_split(df.repartition(p), "id", None, 0.3, 1).where("split = 'test'").collect()) for p in (1, 3, 7)]
    assert sides == [[0, 1, 2]] * 3
    folds = kfold_ids(df, "id", 5, 1).groupBy("fold").count().collect()
    assert sorted((r["fold"], r["count"]) for r in folds) == [(f, 2) for f in range(5)]


def test_split_sizes_exact_and_quotas(spark):
    df = _frame(spark, 1003)
    sp = train_test_split(df, "id", "y", 0.2, 42)
    n_test = math.ceil(0.2 * 1003)
    counts = {(r["split"], r["y"]): r["count"] for r in sp.groupBy("split", "y").count().collect()}
    assert sum(v for (s, _), v in counts.items() if s == "test") == n_test
    class_n = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    quotas = train_quotas(sorted(class_n.items()), 1003 - n_test)
    for k, q in quotas.items():
        assert counts[("train", k)] == q
        assert counts[("test", k)] == class_n[k] - q
    assert sp.count() == 1003 and sp.select("id").distinct().count() == 1003


def test_split_deterministic_and_seed_sensitive(spark):
    df = _frame(spark, 300)
    a = {r.id for r in train_test_split(df, "id", "y", 0.25, 1).where("split = 'test'").collect()}
    b = {r.id for r in train_test_split(df, "id", "y", 0.25, 1).where("split = 'test'").collect()}
    c = {r.id for r in train_test_split(df, "id", "y", 0.25, 2).where("split = 'test'").collect()}
    assert a == b and a != c


def test_largest_remainder_allocation():
    assert train_quotas([("a", 5), ("b", 5)], 5) in ({"a": 3, "b": 2}, {"a": 2, "b": 3})
    q = train_quotas([("a", 1), ("b", 2), ("c", 7)], 7)
    assert sum(q.values()) == 7 and q["c"] in (4, 5)


def test_single_member_class_rejected(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, y int")
    with pytest.raises(PipelineError):
        train_test_split(df, "id", "y", 0.34, 42)


def test_kfold_partition_and_sizes(spark):
    df = _frame(spark, 1003)
    f = kfold_ids(df, "id", 5, 42)
    sizes = sorted((r["fold"], r["count"]) for r in f.groupBy("fold").count().collect())
    assert sizes == [(0, 201), (1, 201), (2, 201), (3, 200), (4, 200)]


def test_unshuffled_kfold_follows_id_order(spark):
    df = _frame(spark, 10)
    f = {r.id: r.fold for r in kfold_ids(df, "id", 3, shuffle=False).collect()}
    assert [f[i] for i in range(10)] == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_stratified_kfold_balance(spark):
    df = _frame(spark, 1000)
    f = stratified_kfold_ids(df, "id", "y", 5, 42)
    per = {(r["fold"], r["y"]): r["count"] for r in f.groupBy("fold", "y").count().collect()}
    for k, n in ((0, 600), (1, 300), (2, 100)):
        got = [per.get((fold, k), 0) for fold in range(5)]
        assert max(got) - min(got) <= 1 and sum(got) == n
    totals = [sum(per.get((fold, k), 0) for k in (0, 1, 2)) for fold in range(5)]
    assert max(totals) - min(totals) <= 1


def test_many_classes_use_join_lookup(spark):
    from tabwise.operators import split as SP
    rows = [(i, i % 100) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, y int")
    sp = SP.train_test_split(df, "id", "y", 0.25, 3)
    per = {r["y"]: r["count"] for r in sp.where("split = 'test'").groupBy("y").count().collect()}
    assert sum(per.values()) == 500 and set(per.values()) == {5}
    f = SP.stratified_kfold_ids(df, "id", "y", 4, 3)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert sorted(sizes) == [500, 500, 500, 500]


@pytest.mark.parametrize("rows_per_bucket", [1 << 16, 8])
def test_rank_segments_match_brute_force(spark, rows_per_bucket):
    from tabwise.operators.ranking import rank_segments
    df = _frame(spark, 900)
    cuts = {0: [100, 101, 400], 1: [0, 270], 2: [5]}
    got = rank_segments(df, ["id"], 9, cuts, "y", rows_per_bucket=rows_per_bucket)
    w = Window.partitionBy("y").orderBy(hash_key(["id"], 9), "id")
    ranks = {(r.id): (r.y, r.rk) for r in df.withColumn("rk", F.row_number().over(w) - 1).collect()}
    rows = got.collect()
    assert len(rows) == 900
    for r in rows:
        y, rk = ranks[r.id]
        assert r._seg == sum(1 for c in cuts[y] if c <= rk)
