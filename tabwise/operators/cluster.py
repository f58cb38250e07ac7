"""Clustering: K-means with restarts, diagnostics, silhouette, profiles, segment names.

Per-cluster statistics (k centres of d dimensions, counts, norm sums) are the
only things brought to the driver — O(k·d), independent of the row count —
and are fed back as literal arrays so assignment and silhouette are per-row
expressions in codegen: no join against a centre table and no pair generation.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib import clustering as rdd_clustering
from pyspark.mllib.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.errors import PipelineError
from tabwise.functions.columns import share_equal_ci
from tabwise.session import ensure_parallelism

MAX_CENTRES = 10_000

# The four segment names of the income/spending quadrants.
SEGMENT_HIGH_HIGH = "High-value customers"
SEGMENT_HIGH_LOW = "High-income cautious spenders"
SEGMENT_LOW_HIGH = "Enthusiastic value shoppers"
SEGMENT_LOW_LOW = "Budget-conscious customers"


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _as_array(df: DataFrame, features: list[str] | str) -> Column:
    if isinstance(features, str):
        dtype = df.schema[features].dataType.simpleString()
        if dtype.startswith("array"):
            return F.transform(F.col(features), lambda x: x.cast("double"))
        return vector_to_array(F.col(features))
    return F.array(*[F.col(c).cast("double") for c in features])


def _literal_matrix(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])


# --------------------------------------------------------------------------- stats
@dataclass
class ClusterStats:
    ids: list            # cluster ids in ascending order
    counts: list[int]
    sums: list[list[float]]      # of coordinates less the origin
    sq_norm_sums: list[float]    # of the same
    origin: list[float]          # the mean of all rows: sums stay exact far from zero

    @property
    def centres(self) -> list[list[float]]:
        return [[x / n + o for x, o in zip(s, self.origin)] for s, n in zip(self.sums, self.counts)]


def _shifted(x: Column, origin: list[float]) -> Column:
    return F.zip_with(x, F.array(*[F.lit(float(o)) for o in origin]), lambda a, b: a - b)


def cluster_stats(df: DataFrame, features: list[str] | str, cluster_col: str) -> ClusterStats:
    """Counts, coordinate sums and squared-norm sums per cluster: the mean of all rows, then one aggregation about it."""
    points = df.select(F.col(cluster_col).alias("c"), _as_array(df, features).alias("x"))
    mean = points.agg(Summarizer.mean(array_to_vector("x")).alias("m")).first()["m"]
    if mean is None:
        raise PipelineError("Cluster statistics need at least one row")
    origin = [float(v) for v in mean]
    near = points.select("c", _shifted(F.col("x"), origin).alias("x"))
    sq = F.aggregate(F.col("x"), F.lit(0.0), lambda acc, v: acc + v * v)
    rows = (near.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum(sq).alias("psi"),
                                  Summarizer.sum(array_to_vector("x")).alias("s"))
            .limit(MAX_CENTRES + 1).collect())
    if len(rows) > MAX_CENTRES:
        raise PipelineError(f"More clusters than the supported {MAX_CENTRES}")
    rows.sort(key=lambda r: r["c"])
    return ClusterStats([r["c"] for r in rows], [int(r["n"]) for r in rows], [[float(v) for v in r["s"]] for r in rows],
                        [float(r["psi"]) for r in rows], origin)


# --------------------------------------------------------------------------- X4
def assign_nearest(df: DataFrame, features: list[str] | str, centres: list[list[float]],
                   ids: list | None = None, out_col: str = "cluster",
                   dist_col: str | None = "sq_distance") -> DataFrame:
    """Nearest centre by squared Euclidean distance (first centre wins ties)."""
    ids = ids if ids is not None else list(range(len(centres)))
    x = _as_array(df, features)
    c = _literal_matrix(centres)
    d = F.transform(c, lambda ctr: F.aggregate(F.zip_with(x, ctr, lambda a, b: (a - b) * (a - b)),
                                              F.lit(0.0), lambda acc, v: acc + v))
    out = df.withColumn("_d", d)
    pos = F.array_position(F.col("_d"), F.array_min(F.col("_d")))
    id_arr = F.array(*[F.lit(i) for i in ids])
    out = out.withColumn(out_col, F.element_at(id_arr, pos.cast("int")))
    if dist_col:
        out = out.withColumn(dist_col, F.array_min(F.col("_d")))
    return out.drop("_d")


def wcss(df: DataFrame, dist_col: str = "sq_distance") -> float:
    return float(df.agg(F.sum(dist_col)).first()[0] or 0.0)


# --------------------------------------------------------------------------- A24
def silhouette_points(df: DataFrame, features: list[str] | str, cluster_col: str,
                      stats: ClusterStats | None = None, out_col: str = "silhouette") -> DataFrame:
    """Per-point silhouette with squared Euclidean distance, computed in O(n·k·d).

    Mean squared distance from x to cluster C is ‖x‖² + Ψ_C/n_C − 2·x·S_C/n_C,
    with S_C the coordinate sums and Ψ_C the sum of squared norms of C; for x's
    own cluster the sum is divided by n_C − 1 (x itself contributes 0).  All are
    taken about the mean of the data, so nothing cancels far from zero.
    Singleton clusters score 0.  Same definition as Spark's ClusteringEvaluator.
    """
    stats = stats or cluster_stats(df, features, cluster_col)
    if len(stats.ids) < 2:
        raise PipelineError("Silhouette needs at least two clusters")
    x = _shifted(_as_array(df, features), stats.origin)
    sums = _literal_matrix(stats.sums)
    psi = F.array(*[F.lit(float(p)) for p in stats.sq_norm_sums])
    cnt = F.array(*[F.lit(float(n)) for n in stats.counts])
    idx = F.array(*[F.lit(i) for i in stats.ids])
    work = df.withColumn("_x", x).withColumn("_nx", F.aggregate(F.col("_x"), F.lit(0.0), lambda a, v: a + v * v))
    own_pos = F.array_position(idx, F.col(cluster_col)).cast("int")
    work = work.withColumn("_own", own_pos)
    k = len(stats.ids)
    mean_d = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: (
        F.col("_nx") * F.element_at(cnt, j) + F.element_at(psi, j)
        - F.lit(2.0) * _dot(F.col("_x"), F.element_at(sums, j))))
    work = work.withColumn("_sd", mean_d)  # sums of squared distances to each cluster
    n_own = F.element_at(cnt, F.col("_own"))
    a = F.element_at(F.col("_sd"), F.col("_own")) / (n_own - F.lit(1.0))
    others = F.filter(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: F.when(
        j != F.col("_own"), F.element_at(F.col("_sd"), j) / F.element_at(cnt, j))), lambda v: v.isNotNull())
    b = F.array_min(others)
    s = (F.when(n_own <= F.lit(1.0), F.lit(0.0))
         .when(a < b, F.lit(1.0) - a / b)
         .when(a > b, b / a - F.lit(1.0))
         .otherwise(F.lit(0.0)))
    return work.withColumn(out_col, s).drop("_x", "_nx", "_own", "_sd")


def silhouette_score(df: DataFrame, features: list[str] | str, cluster_col: str,
                     stats: ClusterStats | None = None) -> float:
    pts = silhouette_points(df, features, cluster_col, stats)
    return float(pts.agg(F.avg("silhouette")).first()[0])


# --------------------------------------------------------------------------- E6 / M4
@dataclass
class KMeansResult:
    k: int
    wcss: float
    seed: int
    features: list[str] | str
    centre_rows: list[list[float]]
    cluster_sizes: list[int]

    def centres(self) -> list[list[float]]:
        return self.centre_rows

    def sizes(self) -> list[int]:
        return self.cluster_sizes


def vectorize(df: DataFrame, features: list[str] | str, out_col: str = "features") -> DataFrame:
    if isinstance(features, str):
        dtype = df.schema[features].dataType.simpleString()
        if dtype.startswith("array"):
            return df.withColumn(out_col, array_to_vector(F.col(features)))
        return df.withColumn(out_col, F.col(features)) if features != out_col else df
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol=out_col).transform(df)


def distance_draws(points: DataFrame, k: int, seeds: list[int]) -> list[list[list[float]]]:
    """k-means++ centres for each seed: each next one a row drawn with a chance proportional to its squared
    distance from the centres so far (D² weighting), the first one at equal chances.

    One pass over ``points (x array<double>)`` a centre serves all seeds: a row's
    exponential waiting time over its weight is compared, and the least waits
    (a weighted reservoir of one).  Draws follow the row's place, so ``points`` should
    be persisted or a scan.  With fewer than ``k`` distinct rows, these are the centres.
    """
    shared = None
    drawn: list[list[list[float]]] = [[] for _ in seeds]
    for step in range(k):
        if step == 0:
            weights = F.array(*[F.lit(1.0) for _ in seeds])
        else:
            shared = points.sparkSession.sparkContext.broadcast([np.array(c) for c in drawn])
            weights = _squared_distances(shared)(F.col("x"))
        waits = points.select("x", weights.alias("w"), *[F.rand(s * 1_000_003 + step).alias(f"u{i}") for i, s in enumerate(seeds)])
        race = [F.min(F.when(F.col("w")[i] > 0, F.struct((-F.log(F.lit(1.0) - F.col(f"u{i}")) / F.col("w")[i]).alias("wait"), "x")))
                .alias(f"first{i}") for i in range(len(seeds))]
        row = waits.agg(*race).first()
        if shared is not None:
            shared.destroy()
        if row["first0"] is None:
            break
        for i, centres in enumerate(drawn):
            if row[f"first{i}"] is not None:
                centres.append(list(row[f"first{i}"]["x"]))
    return drawn


def _squared_distances(shared):
    """Column function: for each list of centres, the squared distance of a row from the nearest."""

    @F.pandas_udf("array<double>")
    def nearest(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        at = np.stack(x.to_numpy())
        out = np.full((len(at), len(shared.value)), np.inf)
        for i, centres in enumerate(shared.value):
            for centre in centres:
                out[:, i] = np.minimum(out[:, i], ((at - centre) ** 2).sum(axis=1))
        return pd.Series(list(out))

    return nearest


def fit_kmeans(df: DataFrame, features: list[str] | str, k: int, init: str = "k-means||",
               n_init: int = 10, max_iter: int = 300, tol: float = 1e-4, seed: int = 42,
               parallelism: int = 4) -> KMeansResult:
    """Best of ``n_init`` seeded restarts by WCSS (training cost).

    ``init``: 'k-means++' (D² draws, one pass a centre for all restarts; the
    iterations are those of Spark's RDD-based K-means, the only one that takes
    given centres), 'k-means||' (Spark's scalable variant) or 'random'.
    The caller should cache ``df``; each restart is an iterative Spark job.
    """
    if init not in ("k-means++", "k-means||", "random"):
        raise PipelineError(f"No such K-means start: {init}")
    owned = "_features" not in df.columns
    # assemble once and share the cached vectors between concurrent restarts
    data = vectorize(df, features, "_features").persist() if owned else df

    if init == "k-means++":
        starts = distance_draws(data.select(vector_to_array("_features").alias("x")), k, [seed + r for r in range(n_init)])
        vectors = data.select("_features").rdd.map(lambda row: Vectors.fromML(row[0]))

    def one(r: int) -> KMeansResult:
        if init == "k-means++":
            model = rdd_clustering.KMeans.train(vectors, len(starts[r]), max_iter, epsilon=tol, seed=seed + r,
                                                initialModel=rdd_clustering.KMeansModel([Vectors.dense(c) for c in starts[r]]))
            centres = [[float(v) for v in c] for c in model.clusterCenters]
            assigned = assign_nearest(data.select("_features"), "_features", centres)
            found = {row["cluster"]: row for row in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"),
                                                                                    F.sum("sq_distance").alias("cost")).collect()}
            sizes = [int(found[i]["n"]) if i in found else 0 for i in range(len(centres))]
            return KMeansResult(k, sum(float(row["cost"]) for row in found.values()), seed + r, features, centres, sizes)
        model = KMeans(k=k, initMode=init, maxIter=max_iter, tol=tol, seed=seed + r,
                       featuresCol="_features", predictionCol="_cluster").fit(data)
        return KMeansResult(k, float(model.summary.trainingCost), seed + r, features,
                            [[float(v) for v in c] for c in model.clusterCenters()], [int(n) for n in model.summary.clusterSizes])

    # Restarts are independent fits: run them as concurrent Spark jobs, keep the lowest WCSS
    # (ties → the earliest seed, as a sequential loop would).
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, n_init))) as pool:
        results = list(pool.map(one, range(n_init)))
    if owned:
        data.unpersist()
    return min(results, key=lambda res: (res.wcss, res.seed))


def predict_clusters(result: KMeansResult, df: DataFrame, out_col: str = "Cluster") -> DataFrame:
    return assign_nearest(df, result.features, result.centres(), out_col=out_col, dist_col=None)


def cluster_diagnostics(df: DataFrame, features: list[str] | str, k_values, init: str = "k-means||",
                        n_init: int = 10, max_iter: int = 300, seed: int = 42,
                        parallelism: int = 4) -> DataFrame:
    """Per k: WCSS and (squared Euclidean) silhouette of the best restart — one fit per k.

    The assembled vectors are persisted once and shared by every k and restart.
    """
    k_values = list(k_values)
    data = ensure_parallelism(vectorize(df, features, "_features")).persist()

    def one(k):
        res = fit_kmeans(data, features, int(k), init, n_init, max_iter, seed=seed, parallelism=1)
        labelled = predict_clusters(res, data, "_c")
        return (int(k), res.wcss, silhouette_score(labelled, features, "_c"), "squared_euclidean")

    # Fits for different k are independent Spark jobs: run them concurrently.
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(k_values)))) as pool:
        rows = list(pool.map(one, k_values))
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "cluster int, WCSS_Score double, Silhouette_Score double, Silhouette_Metric string")


def centre_table(spark, result: KMeansResult, names: list[str] | None = None) -> DataFrame:
    """Cluster centres and sizes as a small table (k rows)."""
    cs = result.centres()
    names = names or [f"f{j}" for j in range(len(cs[0]))]
    sizes = result.sizes()
    rows = [(i, int(sizes[i]), *map(float, c)) for i, c in enumerate(cs)]
    schema = "Cluster int, size bigint, " + ", ".join(f"`{n}` double" for n in names)
    return spark.createDataFrame(rows, schema)


# --------------------------------------------------------------------------- A18 / A19
def cluster_profile(df: DataFrame, cluster_col: str, id_col: str, mean_cols: dict,
                    share: tuple[str, str, str] | None = None) -> DataFrame:
    """Per cluster: non-null id count, means, and a case-insensitive share (%)."""
    aggs = [F.count(F.col(id_col)).alias("Customers")]
    aggs += [F.avg(F.col(src).cast("double")).alias(name) for name, src in mean_cols.items()]
    if share:
        name, col, value = share
        aggs.append((F.lit(100.0) * F.avg(share_equal_ci(col, value))).alias(name))
    return df.groupBy(cluster_col).agg(*aggs).orderBy(cluster_col)


# --------------------------------------------------------------------------- A20 / J1
def segment_names(profile: DataFrame, cluster_col: str, income_col: str, spend_col: str,
                  out_col: str = "Segment") -> DataFrame:
    """Quadrant names against the median (over clusters) of two profile means, ``>=`` on both.

    The profile has one row per cluster (bounded by k), so its medians are a tiny
    aggregate; names may repeat — key results by cluster id, never by name.
    """
    med = profile.agg(F.median(income_col).alias("mi"), F.median(spend_col).alias("ms")).first()
    hi_inc = F.col(income_col) >= F.lit(med["mi"])
    hi_sp = F.col(spend_col) >= F.lit(med["ms"])
    name = (F.when(hi_inc & hi_sp, F.lit(SEGMENT_HIGH_HIGH))
            .when(hi_inc & ~hi_sp, F.lit(SEGMENT_HIGH_LOW))
            .when(~hi_inc & hi_sp, F.lit(SEGMENT_LOW_HIGH))
            .otherwise(F.lit(SEGMENT_LOW_LOW)))
    return profile.select(cluster_col, name.alias(out_col))


def attach_segments(df: DataFrame, names: DataFrame, cluster_col: str) -> DataFrame:
    """Dictionary lookup: one name row per cluster, broadcast after checking k ≤ MAX_CENTRES
    (a regular shuffle join otherwise)."""
    k = names.count()
    right = F.broadcast(names) if k <= MAX_CENTRES else names
    return df.join(right, cluster_col, "left")
