"""Trees and forests grown level by level from histograms, for what Spark ML's trees lack.

Criteria ``absolute_error``, ``poisson``, ``squared_error`` and ``friedman_mse``
for numbers, ``gini``, ``entropy`` and ``log_loss`` for classes, each with any
``min_samples_split``.  One job handles the nodes of a level, of all trees and all
wanted criteria together: tasks walk their rows down the trees so far and add up
sufficient statistics by (node, feature, bin), Spark sums these, and each (node,
feature) finds its best cut.  Nodes of the same rows share their statistics between
criteria, each of which chooses its own cut from them.  Only cuts reach the driver,
which holds the model.

* A feature with at most ``max_bins`` distinct values can be cut between any two
  of them, halfway between the node's own neighbours, as in an exact tree;
  others at the cut points of a quantile sketch.
* Statistics are class weights, or weight, sum and square sum of the centred
  label, or (``absolute_error``) weights by label value.  Labels with more than
  ``label_bins`` distinct values count as the mean of their quantile bin there.
* Of equally good cuts (to nine digits) the first feature's lowest is taken.  A
  node whose best cut gains nothing is still cut, as long as it is not pure.
* Statistics of a job are bounded by CELLS numbers a task: levels with more
  nodes than fit take several jobs.
* Binned rows are written once, as blocks of arrays: handing rows to Python one by
  one costs more than all that a level does with them.
* Bootstrap weights are Poisson numbers drawn from a hash of the row's id, so a
  task that runs again draws the same.  ``min_samples_split`` counts rows drawn,
  once each.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.errors import PipelineError
from tabwise.functions.columns import quoted
from tabwise.session import materialize

CELLS = 1 << 22
# Binned rows are kept in blocks of about so many bytes, a block a row of a table.
BLOCK = 1 << 20
BLOCK_ROWS = 1 << 16
CLASS_CRITERIA = ("gini", "entropy", "log_loss")
NUMBER_CRITERIA = ("squared_error", "friedman_mse", "poisson", "absolute_error")
# P(Poisson(1) <= k)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


# --------------------------------------------------------------------------- criteria
@dataclass
class Criterion:
    """Costs of nodes from their statistics: column 0 the rows, then weights by code, or weight, sum, square sum."""

    name: str
    values: np.ndarray | None = None    #: label of each code; None for moments
    centre: float = 0.0                 #: taken off the label in moments

    @property
    def width(self) -> int:
        return 4 if self.values is None else 1 + len(self.values)

    def _median(self, weights: np.ndarray) -> np.ndarray:
        below = np.cumsum(weights, axis=1)
        half = below[:, -1:] / 2
        lower = self.values[np.minimum((below < half).sum(axis=1), len(self.values) - 1)]
        upper = self.values[np.minimum((below <= half).sum(axis=1), len(self.values) - 1)]
        return (lower + upper) / 2

    def cost(self, stats: np.ndarray) -> np.ndarray:
        """Weighted impurity of each row of ``stats``; 0 for empty nodes."""
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.values is None:
                n, s, q = stats[:, 1], stats[:, 2], stats[:, 3]
                if self.name == "poisson":     # without the part that no cut changes
                    total = s + n * self.centre
                    out = -total * np.log(total / n)
                else:
                    out = q - s * s / n
            else:
                w = stats[:, 1:]
                n = w.sum(axis=1)
                if self.name == "absolute_error":
                    out = (w * np.abs(self.values - self._median(w)[:, None])).sum(axis=1)
                elif self.name == "gini":
                    out = n - (w * w).sum(axis=1) / n
                else:
                    out = n * np.log2(n) - np.where(w > 0, w * np.log2(w), 0.0).sum(axis=1)
        return np.where(stats[:, 0] > 0, out, 0.0)

    def pure(self, stats: np.ndarray) -> bool:
        if self.values is not None:
            return int((stats[1:] > 0).sum()) <= 1
        return stats[3] - stats[2] ** 2 / stats[1] <= 1e-12 * max(stats[3], 1e-300)

    def scale(self, stats: np.ndarray) -> float:
        """What gains are measured by: differences of less than nine digits of it are rounding errors."""
        scale = stats[2] + stats[1] * self.centre if self.name == "poisson" else self.cost(stats[None])[0]
        return float(scale) if scale > 0 else 1.0

    def allowed(self, stats: np.ndarray) -> np.ndarray:
        some = stats[:, 0] > 0
        return some & (stats[:, 2] + stats[:, 1] * self.centre > 1e-12) if self.name == "poisson" else some

    def leaf(self, stats: np.ndarray) -> list[float]:
        """The mean or median, or a probability for each class."""
        if self.values is None:
            return [float(stats[2] / stats[1] + self.centre)]
        if self.name == "absolute_error":
            return [float(self._median(stats[None, 1:])[0])]
        return [float(v) for v in stats[1:] / stats[1:].sum()]


def best_cut(stats: np.ndarray, criterion: Criterion) -> tuple[int, float]:
    """(last bin of the left side, gain) of the best cut of (bins, width) statistics; (-1, -inf) if there is none."""
    left = np.cumsum(stats, axis=0)[:-1]
    total = stats.sum(axis=0)
    right = total - left
    fits = criterion.allowed(left) & criterion.allowed(right)
    if not fits.any():
        return -1, -math.inf
    gain = np.full(len(left), -math.inf)
    gain[fits] = criterion.cost(total[None])[0] - criterion.cost(left[fits]) - criterion.cost(right[fits])
    cut = int(np.argmax(np.round(gain / criterion.scale(total), 9)))
    return cut, float(gain[cut])


# --------------------------------------------------------------------------- model
class Tree:
    """Nodes as parallel lists; ``feature`` is -1 at leaves."""

    def __init__(self) -> None:
        self.feature, self.bin, self.threshold = [-1], [0], [math.nan]
        self.left, self.right, self.stats = [0], [0], [None]
        self.gain = [0.0]

    def cut(self, node: int, feature: int, last_bin: int, threshold: float, gain: float, sides: list[np.ndarray]) -> list[int]:
        new = [len(self.feature), len(self.feature) + 1]
        self.feature[node], self.bin[node], self.threshold[node], self.gain[node] = feature, last_bin, threshold, gain
        self.left[node], self.right[node] = new
        for side in sides:
            for column, value in ((self.feature, -1), (self.bin, 0), (self.threshold, math.nan), (self.left, 0),
                                  (self.right, 0), (self.stats, side), (self.gain, 0.0)):
                column.append(value)
        return new


def _walk(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The leaf of each row, a column of ``x``: left where its value is at most the node's ``cut``."""
    values, n = x.ravel(), x.shape[1]
    node = np.zeros(n, np.int64)
    rows, at = (np.arange(n), node) if feature[0] >= 0 else (node[:0], node[:0])
    while len(rows):
        at = np.where(values.take(feature[at] * n + rows) <= cut[at], left[at], right[at])
        node[rows] = at
        inner = feature[at] >= 0
        if not inner.all():
            rows, at = rows[inner], at[inner]
    return node


@dataclass
class TreeTable:
    """A fitted tree or forest; ``nodes`` has one row a node: tree, node, feature (index, -1 at leaves), threshold,
    left, right, n (rows of the sample), gain, leaf_values."""

    features: list[str]
    label: str
    classes: list | None
    nodes: list[tuple]
    params: dict

    SCHEMA = ("tree int, node int, feature int, threshold double, `left` int, `right` int, n bigint, gain double, "
              "leaf_values array<double>")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, self.SCHEMA)

    @classmethod
    def from_table(cls, table: DataFrame, features: list[str], label: str, classes: list | None, params: dict) -> TreeTable:
        rows = table.orderBy("tree", "node").select("tree", "node", "feature", "threshold", "left", "right", "n", "gain", "leaf_values")
        return cls(list(features), label, classes, [tuple(r) for r in rows.collect()], params)

    def importances(self) -> list[float]:
        """Gain by feature, as a share of its tree's; the mean over trees."""
        trees = 1 + max(r[0] for r in self.nodes)
        by_tree = np.zeros((trees, len(self.features)))
        for tree, _, feature, *_, gain, _ in self.nodes:
            if feature >= 0:
                by_tree[tree, feature] += gain
        total = by_tree.sum(axis=1, keepdims=True)
        return [float(v) for v in np.divide(by_tree, total, out=np.zeros_like(by_tree), where=total > 0).mean(axis=0)]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, and ``probability`` for classes: the mean over trees.  Absent and missing features are 0.0."""
        trees = []
        for number in range(1 + max(r[0] for r in self.nodes)):
            rows = [r for r in self.nodes if r[0] == number]
            trees.append((np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([r[4] for r in rows]),
                          np.array([r[5] for r in rows]), np.array([r[8] for r in rows], float)))
        shared = df.sparkSession.sparkContext.broadcast(trees)
        width = len(self.nodes[0][8])

        def mean_leaf(*columns: pa.Array) -> pa.Array:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns])
            mean = sum(value[_walk(feature, cut, left, right, x)] for feature, cut, left, right, value in shared.value) / len(shared.value)
            if width == 1:
                return pa.array(mean[:, 0])
            return pa.ListArray.from_arrays(pa.array(np.arange(len(mean) + 1, dtype=np.int32) * width), pa.array(mean.ravel()))

        x = [F.coalesce(F.nanvl(quoted(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c in df.columns else F.lit(0.0)
             for c in self.features]
        kind = "double" if width == 1 else "array<double>"
        values = F.arrow_udf(mean_leaf, kind)(*x)
        if self.classes is None:
            return df.withColumn("prediction", values)
        out = df.withColumn("_values", F.array(values) if width == 1 else values)
        first_best = F.array_position("_values", F.array_max("_values")).cast("int")
        named = F.element_at(F.array(*[F.lit(float(c)) for c in self.classes]), first_best)
        return out.withColumn("probability", array_to_vector("_values")).withColumn("prediction", named).drop("_values")


# --------------------------------------------------------------------------- training
def few_values(df: DataFrame, most: dict[str, int], about: dict[str, int]) -> dict[str, list[float] | None]:
    """The ascending distinct values of each column of doubles, or None if it has more than ``most``; one pass for all.

    ``about``: estimated numbers of values.  Columns far above ``most`` are not looked
    at, so a task keeps few values; the others are counted exactly.
    """
    near = [c for c in most if about[c] <= 2 * most[c]]
    if not near:
        return {c: None for c in most}
    row = df.agg(*[F.collect_set(quoted(c) + 0.0).alias(f"v{i}") for i, c in enumerate(near)]).first()      # -0.0 is 0.0
    return {c: None for c in most} | {c: sorted(row[i]) for i, c in enumerate(near) if len(row[i]) <= most[c]}


def cut_points(df: DataFrame, bins: dict[str, int], about: dict[str, int]) -> dict[str, tuple[list[float], list[float] | None]]:
    """For each column (ascending cut points, distinct values if at most ``bins`` else None)."""
    out: dict[str, tuple[list[float], list[float] | None]] = {}
    few = few_values(df, bins, about)
    for number in sorted(set(bins.values())):       # columns of the same bins share a sketching pass
        many = [c for c in bins if bins[c] == number and few[c] is None]
        probabilities = [i / number for i in range(1, number)]
        if many:
            for c, quantiles in zip(many, df.approxQuantile(many, probabilities, 1 / (8 * number))):
                out[c] = sorted(set(quantiles)), None
    for c, values in few.items():
        if values is not None:
            out[c] = [_middle(a, b) for a, b in zip(values, values[1:])], values
    return out


def _middle(a: float, b: float) -> float:
    """A number from a up to, but not including, b > a."""
    middle = a + (b - a) / 2
    return middle if middle < b and math.isfinite(middle) else a


def _weights(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Poisson(1) numbers from hashes of the row keys."""
    with np.errstate(over="ignore"):
        h = key.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return np.searchsorted(_POISSON, (h >> np.uint64(11)).astype(float) / 2**53, "right")


def _small(most: int) -> type:
    """The least unsigned type for numbers up to ``most``."""
    return next(t for t in (np.uint8, np.uint16, np.uint32) if most <= np.iinfo(t).max)


@dataclass
class Layout:
    """What a block of binned rows holds of each row: the kind of its key, label, label code (None: not kept) and bins."""

    key: type | None
    y: type | None
    code: type | None
    x: type
    n_features: int

    @property
    def kinds(self) -> dict[str, type]:
        return {name: kind for name in ("key", "y", "code", "x") if (kind := getattr(self, name)) is not None}

    @property
    def schema(self) -> str:
        return ", ".join(f"{name} binary" for name in self.kinds)

    @property
    def rows(self) -> int:
        width = sum(np.dtype(kind).itemsize * (self.n_features if name == "x" else 1) for name, kind in self.kinds.items())
        return max(1, min(BLOCK_ROWS, BLOCK // width))

    def write(self, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        """One row, of ``columns`` by name (x: a row for each feature)."""
        return pa.RecordBatch.from_pydict({name: pa.array([columns[name].astype(kind).tobytes()], pa.binary()) for name, kind in self.kinds.items()})

    def read(self, batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = {name: np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, (name, kind) in enumerate(self.kinds.items())}
                block["x"] = block["x"].reshape(self.n_features, -1)
                yield block


def _blocks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of ``rows`` rows at a time."""
    held, n = [], 0
    for batch in batches:
        while n + batch.num_rows >= rows:
            held.append(batch.slice(0, rows - n))
            batch = batch.slice(rows - n)
            yield [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(batch.num_columns)]
            held, n = [], 0
        held.append(batch)
        n += batch.num_rows
    if n:
        yield [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(held[0].num_columns)]


@dataclass
class Cells:
    """Statistics that a job adds up: of some nodes of a tree, as weights by code or as moments."""

    coded: bool
    width: int
    tree: int
    path: int               #: place of the tree's nodes among the job's
    nodes: list[int]
    first: int              #: slot of the first node


def _level_cuts(binned: DataFrame, layout: Layout, rules: list[Criterion], forests: list[list[Tree]], wanted: list[tuple[int, int, int]],
                bins: int, seed: int) -> dict[tuple[int, int, int], list]:
    """For each (rule, tree, node) of ``wanted``, by feature: its best cut, gain, and the statistics of both sides."""
    # Trees cut alike so far have the same rows in nodes of the same number: walked once, and added up once a kind of statistics.
    n_features = layout.n_features
    paths: dict[tuple, int] = {}
    sums: dict[tuple, dict[int, list[int]]] = {}        # nodes, and the rules that want them
    for rule, tree, node in wanted:
        grown = forests[rule][tree]
        path = paths.setdefault((tuple(grown.feature), tuple(grown.bin), tuple(grown.left), tuple(grown.right)), len(paths))
        sums.setdefault((rules[rule].values is not None, rules[rule].width, tree, path), {}).setdefault(node, []).append(rule)
    walks = [(np.array(f), np.array(cut, layout.x), np.array(left), np.array(right)) for f, cut, left, right in paths]
    parts, users = [], []
    for of, nodes in sums.items():
        parts.append(Cells(*of, list(nodes), len(users)))
        users += [(of[2], node, users_of) for node, users_of in nodes.items()]
    centre = next((r.centre for r in rules if r.values is None), 0.0)
    kind = pa.schema([("slot", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("stat", pa.int32()), ("value", pa.float64())])

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = [(len(p.nodes), n_features, bins, p.width) for p in parts]
        totals = [np.zeros(math.prod(shape)) for shape in shapes]
        slots = []
        for p in parts:
            slot_of = np.full(len(walks[p.path][0]), -1)
            slot_of[p.nodes] = range(len(p.nodes))
            slots.append(slot_of)
        for block in layout.read(batches):
            x = block["x"]
            at_node = [_walk(*walk, x) for walk in walks]
            for p, slot_of, total in zip(parts, slots, totals):
                slot = slot_of[at_node[p.path]]
                weight = _weights(block["key"], seed, p.tree) if layout.key else np.ones(len(slot), np.int64)
                used = np.flatnonzero((slot >= 0) & (weight > 0))
                place, w = slot[used] * (n_features * bins * p.width), weight[used].astype(float)
                if p.coded:
                    stats = [(w, 1 + block["code"][used].astype(np.int64))]
                else:
                    label = block["y"][used] - centre
                    stats = [(w, 1), (w * label, 2), (w * label * label, 3)]
                for f in range(n_features):
                    at = place + (f * bins + x[f][used].astype(np.int64)) * p.width
                    np.add.at(total, at, 1.0)
                    for v, stat in stats:
                        np.add.at(total, at + stat, v)
        for p, shape, total in zip(parts, shapes, totals):
            for place in np.array_split(np.flatnonzero(total), max(1, np.count_nonzero(total) >> 16)):
                slot, *rest = (c.astype(np.int32) for c in np.unravel_index(place, shape))
                yield pa.RecordBatch.from_arrays([pa.array(slot + np.int32(p.first)), *map(pa.array, rest), pa.array(total[place])], schema=kind)

    found = pa.schema([("rule", pa.int32()), ("slot", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), ("next", pa.int32()),
                       ("gain", pa.float64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        slot, rows = key[0].as_py(), []
        for rule in users[slot][2]:
            stats = np.zeros((bins, rules[rule].width))
            stats[table["bin"].to_numpy(), table["stat"].to_numpy()] = table["value"].to_numpy()
            cut, gain = best_cut(stats, rules[rule])
            low, high = stats[:cut + 1].sum(axis=0), stats[cut + 1:].sum(axis=0)
            above = cut + 1 + int(np.argmax(stats[cut + 1:, 0] > 0))       # the next bin with rows of the node
            rows.append({"rule": rule, "slot": slot, "feature": key[1].as_py(), "cut": cut, "next": above, "gain": gain,
                         "low": low.tolist(), "high": high.tolist()})
        return pa.Table.from_pylist(rows, schema=found)

    # placed once by (slot, feature): sums and cuts need no other shuffle
    cells = binned.mapInArrow(add_up, "slot int, feature int, bin int, stat int, value double").repartition("slot", "feature")
    added = cells.groupBy("slot", "feature", "bin", "stat").agg(F.sum("value").alias("value"))
    cuts = added.groupBy("slot", "feature").applyInArrow(choose, "rule int, slot int, feature int, cut int, next int, gain double, low array<double>, high array<double>")
    out: dict[tuple[int, int, int], list] = {}
    for r in cuts.collect():       # one row a rule, node and feature, of at most CELLS statistics in all
        out.setdefault((r["rule"], *users[r["slot"]][:2]), []).append(r)
    return out


def _pick(rows: list, criterion: Criterion, tree: int, node: int, wanted: int, n_features: int, seed: int):
    """The best row among ``wanted`` features drawn for the node; further features only while none can be cut."""
    drawn = np.random.default_rng((seed, tree, node)).permutation(n_features) if wanted < n_features else np.arange(n_features)
    by_feature = {r["feature"]: r for r in rows if r["cut"] >= 0}
    usable = [f for f in drawn[:wanted] if f in by_feature] or [f for f in drawn if f in by_feature][:1]
    if not usable:
        return None
    usable.sort()
    scale = criterion.scale(np.array(rows[0]["low"]) + np.array(rows[0]["high"]))
    return by_feature[usable[int(np.argmax(np.round(np.array([by_feature[f]["gain"] for f in usable]) / scale, 9)))]]


def _code_means(binned: DataFrame, layout: Layout, codes: int) -> dict[int, float]:
    """The mean label of each code."""
    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(codes, np.int64), np.zeros(codes)
        for block in layout.read(batches):
            n += np.bincount(block["code"], minlength=codes)
            total += np.bincount(block["code"], block["y"], codes)
        code = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"code": code.astype(np.int32), "n": n[code], "total": total[code]})

    sums = binned.mapInArrow(add_up, "code int, n bigint, total double").groupBy("code").agg((F.sum("total") / F.sum("n")).alias("v"))
    return {r["code"]: r["v"] for r in sums.collect()}


def fit_trees(df: DataFrame, features: list[str], label: str, criterion: str | Sequence[str], n_estimators: int = 1,
              max_depth: int | None = None, min_samples_split: int = 2, max_features: int | None = None,
              id_cols: list[str] | None = None, max_bins: int = 64, label_bins: int = 256,
              seed: int = 42) -> TreeTable | dict[str, TreeTable]:
    """Fit one tree on all rows, or with ``id_cols`` a forest of ``n_estimators`` bootstrap trees.

    Several criteria are fitted in the same passes over the rows, and give a model each, by name.
    ``max_features``: features drawn for each node (all by default).  ``max_depth=None``
    grows until nodes are pure or smaller than ``min_samples_split``.  Rows without a
    label, and missing features, are errors, as are negative labels with ``poisson``.
    """
    criteria = [criterion] if isinstance(criterion, str) else list(dict.fromkeys(criterion))
    for name in criteria:
        if name not in CLASS_CRITERIA + NUMBER_CRITERIA:
            raise PipelineError(f"No such tree criterion: {name}")
    if not criteria or len({name in CLASS_CRITERIA for name in criteria}) > 1:
        raise PipelineError("Trees are fitted by criteria for numbers or for classes")
    if min_samples_split < 2 or n_estimators < 1:
        raise PipelineError("min_samples_split starts at 2 and n_estimators at 1")
    if n_estimators > 1 and not id_cols:
        raise PipelineError("A forest needs id columns to draw its samples by")
    key = F.xxhash64(*[quoted(c) for c in id_cols]) if id_cols else F.lit(0).cast("long")
    data = df.select(key.alias("key"), quoted(label).cast("double").alias("y"),
                     *[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    columns = [c for c in data.columns if c != "key"]
    row = data.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.min("y").alias("low"),
                   *[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"missing_{c}") for c in columns],
                   *[F.approx_count_distinct(c).alias(f"about_{c}") for c in columns]).first()
    if not row["n"] or any(row[f"missing_{c}"] for c in columns):
        raise PipelineError("Trees need at least one row, and labels and features without missing values")
    if "poisson" in criteria and (row["low"] < 0 or row["mean"] <= 0):
        raise PipelineError("The poisson criterion needs labels of 0 or more, and some above 0")

    by_class, by_code = criteria[0] in CLASS_CRITERIA, "absolute_error" in criteria
    wanted_bins = {f"x{i}": max_bins for i in range(len(features))} | ({"y": label_bins} if by_code else {})
    points = cut_points(data, wanted_bins, {c: row[f"about_{c}"] for c in wanted_bins})
    cuts, known = zip(*[points[f"x{i}"] for i in range(len(features))])
    shared = [np.array(c) for c in cuts]
    classes, label_cuts = None, None
    if by_class:
        classes = sorted(r["y"] for r in data.select("y").distinct().collect())     # classes
        label_cuts = np.array(classes[:-1])
    elif by_code:
        label_cuts = np.array(points["y"][0])
    bins = 1 + max(len(c) for c in cuts)
    layout = Layout(np.int64 if n_estimators > 1 else None, None if by_class else np.float64,
                    None if label_cuts is None else _small(len(label_cuts)), _small(bins), len(features))

    def to_bins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, *values in _blocks(batches, layout.rows):
            yield layout.write({"key": values[-1], "y": y, "code": None if label_cuts is None else np.searchsorted(label_cuts, y, "left"),
                                "x": np.stack([np.searchsorted(c, v, "left") for c, v in zip(shared, values)])})

    # small row groups: a reader holds the blocks of one
    binned = materialize(data.select(*columns, *(["key"] if layout.key else [])).mapInArrow(to_bins, layout.schema), **{"parquet.block.size": 32 * BLOCK})
    rules = []
    for name in criteria:
        if by_class:
            rules.append(Criterion("gini" if name == "gini" else "entropy", np.array(classes)))
        elif name == "absolute_error":
            label_points, values = points["y"]
            if values is None:
                means = _code_means(binned, layout, len(label_points) + 1)
                values = [means.get(i, label_points[min(i, len(label_points) - 1)]) for i in range(len(label_points) + 1)]
            rules.append(Criterion(name, np.array(values)))
        else:
            rules.append(Criterion(name, None, float(row["mean"])))

    take = min(max_features or len(features), len(features))
    forests = [[Tree() for _ in range(n_estimators)] for _ in rules]
    level, depth = [(r, t, 0) for r in range(len(rules)) for t in range(n_estimators)], 0
    while level and (max_depth is None or depth < max_depth):
        below: list[tuple[int, int, int]] = []
        for wanted in _jobs(level, [len(features) * bins * rule.width for rule in rules]):
            found = _level_cuts(binned, layout, rules, forests, wanted, bins, seed)
            for (r, tree, node), rows in sorted(found.items()):
                rule, grown = rules[r], forests[r][tree]
                if node == 0:
                    grown.stats[0] = np.array(rows[0]["low"]) + np.array(rows[0]["high"])
                    if grown.stats[0][0] < min_samples_split or rule.pure(grown.stats[0]):
                        continue
                best = _pick(rows, rule, tree, node, take, len(features), seed)
                if best is None:
                    continue
                sides = [np.array(best["low"]), np.array(best["high"])]
                f, values = best["feature"], known[best["feature"]]
                threshold = _middle(values[best["cut"]], values[best["next"]]) if values else cuts[f][best["cut"]]
                new = grown.cut(node, f, best["cut"], threshold, best["gain"], sides)
                below += [(r, tree, n) for n, s in zip(new, sides) if s[0] >= min_samples_split and not rule.pure(s)]
        level, depth = below, depth + 1

    models = {}
    for name, rule, forest in zip(criteria, rules, forests):
        sampled = [g for g in forest if g.stats[0] is not None]      # a small table can leave a tree without rows
        if not sampled:
            raise PipelineError("No tree has drawn a row")
        nodes = [(t, n, g.feature[n], g.threshold[n], g.left[n], g.right[n], int(g.stats[n][0]), float(g.gain[n]), rule.leaf(g.stats[n]))
                 for t, g in enumerate(sampled) for n in range(len(g.feature))]
        models[name] = TreeTable(list(features), label, classes, nodes,
                                 {"criterion": name, "n_estimators": n_estimators, "max_depth": max_depth,
                                  "min_samples_split": min_samples_split, "max_features": max_features})
    return models[criterion] if isinstance(criterion, str) else models


def _jobs(level: list[tuple[int, int, int]], cells: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """The nodes of a level by job: at most CELLS statistics, or one node."""
    part, held = [], 0
    for item in level:
        if part and held + cells[item[0]] > CELLS:
            yield part
            part, held = [], 0
        part.append(item)
        held += cells[item[0]]
    yield part
