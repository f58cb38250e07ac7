import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.errors import PipelineError
from tabwise.operators import cluster as CL
from tabwise.operators import metrics as ME


def test_binary_metrics_zero_division_and_2x2(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "label int, prediction int")
    m = ME.binary_metrics(df).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (0, 0, 2, 1)
    assert m.precision == 0.0 and m.recall == 0.0 and m.f1 == 0.0 and abs(m.accuracy - 1 / 3) < 1e-12
    cm = {r.actual: (r.pred_0, r.pred_1) for r in ME.confusion_matrix(df).collect()}
    assert cm == {0: (1, 0), 1: (2, 0)}


def test_threshold_sweep_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    p, y = rng.random(300), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "probability double, label int")
    ths = [0.2, 0.5, 0.8]
    got = {r.threshold: r for r in ME.threshold_sweep(df, ths).collect()}
    for t in ths:
        pred = (p >= t).astype(int)
        tp = int(((pred == 1) & (y == 1)).sum())
        assert got[t].tp == tp
        assert abs(got[t].accuracy - (pred == y).mean()) < 1e-12


def _brute_silhouette(x, lab):
    n = len(x)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(n):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    return np.array(s)


def test_silhouette_matches_all_pairs_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (30, 3)), rng.normal(4, 1, (25, 3)), [[10.0, 10.0, 10.0]]])
    lab = np.array([0] * 30 + [1] * 25 + [2])  # cluster 2 is a singleton
    df = spark.createDataFrame([(int(i), [float(v) for v in row], int(l)) for i, (row, l) in enumerate(zip(x, lab))],
                               "id long, f array<double>, c int")
    pts = {r.id: r.silhouette for r in CL.silhouette_points(df, "f", "c").collect()}
    want = _brute_silhouette(x, lab)
    assert np.allclose([pts[i] for i in range(len(x))], want, atol=1e-9)
    assert pts[55] == 0.0


def test_silhouette_far_from_zero_and_shifted_statistics(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, (20, 2)), rng.normal(3, 1, (20, 2))]) + 1e8
    lab = np.repeat([0, 1], 20)
    df = spark.createDataFrame([(int(i), [float(v) for v in row], int(l)) for i, (row, l) in enumerate(zip(x, lab))],
                               "id long, f array<double>, c int")
    pts = {r.id: r.silhouette for r in CL.silhouette_points(df, "f", "c").collect()}
    assert np.allclose([pts[i] for i in range(len(x))], _brute_silhouette(x, lab), atol=1e-9)
    centres = CL.cluster_stats(df, "f", "c").centres
    assert np.allclose(centres, [x[lab == i].mean(axis=0) for i in (0, 1)], rtol=1e-15)


def test_distance_draws_follow_the_sampling_law(spark):
    # from 0 the squared distances are 1 (three rows at 1) and 4 (one row at 2), from 2 they are 4 and 1 (three rows), ...
    points = spark.createDataFrame([([v],) for v in (0.0, 1.0, 1.0, 1.0, 2.0)], "x array<double>").coalesce(1).persist()
    seeds = list(range(200))
    batches = [CL.distance_draws(points, 2, seeds[i:i + 20]) for i in range(0, 200, 20)]
    drawn = [centres for batch in batches for centres in batch]
    values = [0.0, 1.0, 1.0, 1.0, 2.0]
    for first in (0.0, 1.0, 2.0):
        after = [c[1][0] for c in drawn if c[0][0] == first]
        share = values.count(first) / 5
        assert abs(len(after) / len(seeds) - share) < 4 * (share * (1 - share) / len(seeds)) ** 0.5
        whole = sum((v - first) ** 2 for v in values)
        for second in set(values) - {first}:
            p = values.count(second) * (second - first) ** 2 / whole
            assert abs(after.count(second) / len(after) - p) < 4 * (p * (1 - p) / len(after)) ** 0.5
    assert batches[0] == CL.distance_draws(points, 2, seeds[:20])
    assert sorted(c[0] for c in CL.distance_draws(points, 5, [3])[0]) == [0.0, 1.0, 2.0]      # no more distinct rows
    assert CL.distance_draws(points.limit(0), 2, [1]) == [[]]
    points.unpersist()


def test_kmeans_plus_plus_finds_far_groups_and_differs_from_the_scalable_start(spark):
    rng = np.random.default_rng(8)
    pts = np.concatenate([rng.normal(c, 0.1, (n, 2)) for c, n in ((0, 300), (50, 5), (80, 5), (110, 5))])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "a double, b double").cache()
    res = CL.fit_kmeans(df, ["a", "b"], 4, "k-means++", n_init=2, max_iter=20, seed=1)
    assert sorted(res.sizes()) == [5, 5, 5, 300]
    want = sum(((pts[i:j] - pts[i:j].mean(axis=0)) ** 2).sum() for i, j in ((0, 300), (300, 305), (305, 310), (310, 315)))
    assert abs(res.wcss - want) < 1e-6
    again = CL.fit_kmeans(df, ["a", "b"], 4, "k-means++", n_init=2, max_iter=20, seed=1)
    assert again.centres() == res.centres()
    with pytest.raises(PipelineError):
        CL.fit_kmeans(df, ["a", "b"], 4, "kmeans")


def test_assign_nearest_and_wcss(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0), (3, 1.0, 0.0)], "id int, a double, b double")
    out = CL.assign_nearest(df, ["a", "b"], [[0.0, 0.0], [10.0, 10.0]], ids=[7, 8])
    got = {r.id: (r.cluster, r.sq_distance) for r in out.collect()}
    assert got == {1: (7, 0.0), 2: (8, 2.0), 3: (7, 1.0)}
    assert CL.wcss(out) == 3.0


def test_segment_names_use_median_over_clusters_and_can_repeat(spark):
    prof = spark.createDataFrame([(0, 10.0, 10.0), (1, 20.0, 20.0), (2, 30.0, 30.0), (3, 25.0, 40.0)],
                                 "Cluster int, inc double, sp double")
    names = {r.Cluster: r.Segment for r in CL.segment_names(prof, "Cluster", "inc", "sp").collect()}
    assert names[0] == CL.SEGMENT_LOW_LOW
    assert names[2] == CL.SEGMENT_HIGH_HIGH and names[3] == CL.SEGMENT_HIGH_HIGH


def test_cluster_profile_female_share_case_insensitive(spark):
    df = spark.createDataFrame([(1, 0, "Female", 10.0), (2, 0, "male", 20.0), (3, 0, None, 30.0), (None, 0, "FEMALE", 40.0)],
                               "id int, Cluster int, g string, age double")
    p = CL.cluster_profile(df, "Cluster", "id", {"Average_Age": "age"}, ("Female_Percent", "g", "female")).first()
    assert p.Customers == 3 and p.Average_Age == 25.0 and p.Female_Percent == 50.0


def test_kmeans_restarts_wcss_non_increasing(spark):
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(pts)], "id int, a double, b double").cache()
    diag = CL.cluster_diagnostics(df, ["a", "b"], [2, 3, 4], n_init=3, max_iter=50)
    w = [r.WCSS_Score for r in diag.orderBy("cluster").collect()]
    assert w[0] >= w[1] >= w[2]
    best = diag.orderBy(F.desc("Silhouette_Score"), "cluster").first()
    assert best.cluster == 3
