"""Exact quantiles, medians and modes without a single-task value map.

Spark's exact ``percentile``/``median``/``mode`` aggregates keep a hash map of
every distinct value; for a global (ungrouped) aggregate the final merge runs
in one task, which does not survive a 100 TB high-cardinality column.

``exact_quantiles`` brackets each wanted order statistic with a mergeable
quantile sketch (one scan, whatever the spread of the values), then counts the
values inside the bracket and those below it (another scan) and picks the rank.
A bracket that may hold more than ``close`` rows is sketched once more first:
two scans up to some 10^10 rows, three up to some 10^12.  Infinities are counted
apart.  Integers stay integers, so values above 2^53 are exact.  A hot value is
one row of the count.  Results use linear interpolation between the two
neighbouring order statistics (SQL ``percentile_cont``, pandas default).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from tabwise.functions.columns import by_position

#: The sketch's rank error is a share of 1 / ACCURACY; a bracket of up to CLOSE rows is counted.
ACCURACY, CLOSE = 10_000, 1 << 22
#: Points at which a wide bracket is sketched again.
GRID = 256


@dataclass
class _Target:
    column: str
    rank: int                     # 0-based order statistic among finite values
    rows: int                     # rows that the bracket may hold
    lo: float | int | None = None     # bracket, both ends included; None: open
    hi: float | int | None = None
    margin: float = 2.0           # in sketch errors
    value: float | int | None = None

    def start_over(self, accuracy: int) -> None:
        """The rank is not in the bracket, beyond the sketch's error: take a wider one, in the end all values."""
        self.lo = self.hi = None
        self.margin *= 4
        if self.margin > accuracy / 8:
            self.rows = 0

    def inside(self, kind: str) -> Column:
        v = F.col(self.column)
        low = F.lit(True) if self.lo is None else v >= F.lit(self.lo).cast(kind)
        return v.isNotNull() & low & (F.lit(True) if self.hi is None else v <= F.lit(self.hi).cast(kind))

    def below(self, kind: str) -> Column:
        return F.lit(False) if self.lo is None else F.coalesce(F.col(self.column) < F.lit(self.lo).cast(kind), F.lit(False))


def _widened(value, kind: str, step: int):
    """A sketch's value as an end of a bracket; sketches hold doubles, so large integers move outwards."""
    if kind == "double":
        return value
    return max(-(1 << 63), min((1 << 63) - 1, int(value) + step * (0 if abs(value) < 1 << 52 else 1 << 11)))


def _bracket(target: _Target, points: list[float], values: list, at: float, accuracy: int, kind: str) -> None:
    """Ends for the share ``at`` of the sketched rows from the sketch's ``values`` at ``points``."""
    reach = target.margin / accuracy
    lows = [v for p, v in zip(points, values) if p <= at - reach]
    highs = [v for p, v in zip(points, values) if p >= at + reach]
    target.lo = _widened(lows[-1], kind, -1) if lows else target.lo
    target.hi = _widened(highs[0], kind, 1) if highs else target.hi


def _sketch_again(data: DataFrame, targets: list[_Target], kinds: dict, accuracy: int) -> None:
    points = [k / GRID for k in range(GRID + 1)]
    aggs = []
    for k, t in enumerate(targets):
        held = t.inside(kinds[t.column])
        aggs += [F.count_if(t.below(kinds[t.column])).alias(f"b{k}"), F.count_if(held).alias(f"n{k}"),
                 F.approx_count_distinct(F.when(held, F.col(t.column))).alias(f"d{k}"),
                 F.percentile_approx(F.when(held, F.col(t.column)), points, accuracy).alias(f"q{k}")]
    row = data.agg(*aggs).first()
    for k, t in enumerate(targets):
        n, want = row[f"n{k}"], t.rank - row[f"b{k}"]
        if not 0 <= want < n:
            t.start_over(accuracy)
            continue
        if t.lo is not None and t.lo == t.hi:
            t.value = t.lo
            continue
        _bracket(t, points, row[f"q{k}"], want / n, accuracy, kinds[t.column])
        t.rows = min(math.ceil(n * (1 / GRID + 4 * t.margin / accuracy)), row[f"d{k}"])     # a count has one row a value


def _close(data: DataFrame, targets: list[_Target], kinds: dict, accuracy: int) -> None:
    """Count the values in the targets' brackets, and the rows below, in one scan; find the wanted ranks."""
    groups: dict[tuple, list[_Target]] = {}
    for t in targets:
        groups.setdefault((t.column, t.lo, t.hi), []).append(t)
    entries = []
    for g, (t, *_) in enumerate(groups.values()):
        kind, none = kinds[t.column], F.lit(None)
        value = [(F.col(t.column) if kind == k else none).cast(k) for k in ("double", "long")]
        entry = lambda x, i: F.struct(F.lit(g).alias("g"), x.cast("double").alias("x"), i.cast("long").alias("i"))  # noqa: B023, E731
        entries.append(F.when(t.inside(kind), entry(*value)).when(t.below(kind), entry(none, none)))
    counts = (data.select(F.explode(F.array_compact(F.array(*entries))).alias("s")).select("s.*")
              .groupBy("g", "x", "i").agg(F.count(F.lit(1)).alias("n")))
    # The rows below a bracket are one row without a value, first in its order.
    order = Window.partitionBy("g").orderBy("x", "i").rowsBetween(Window.unboundedPreceding, 0)
    ranks = F.element_at(F.array(*[F.array(*[F.lit(t.rank).cast("long") for t in ts]) for ts in groups.values()]), F.col("g") + 1)
    found = (counts.withColumn("upto", F.sum("n").over(order)).where(F.coalesce("x", "i").isNotNull())
             .where(F.exists(ranks, lambda r: (F.col("upto") - F.col("n") <= r) & (r < F.col("upto")))).collect())
    members = list(groups.values())
    for row in found:
        for t in members[row["g"]]:
            if row["upto"] - row["n"] <= t.rank < row["upto"]:
                t.value = row["x"] if row["i"] is None else row["i"]
    for t in targets:
        if t.value is None:
            t.start_over(accuracy)


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], accuracy: int = ACCURACY, close: int = CLOSE,
                    stats: dict | None = None, scans: list | None = None) -> dict[str, list[float | None]]:
    """Exact ``percentile_cont`` of each column at each probability (NULL and NaN ignored).

    ``stats`` may carry ``{col: (count, ...)}``: columns without values are left
    out of the scans.  ``scans`` gets an entry for each scan.  Values are floats;
    integers above 2^53 stay integers.
    """
    rows, _ = by_position(df)
    inner = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    if stats is not None:
        stats = {inner[c]: stats[c] for c in columns}
    found = _quantiles(rows, [inner[c] for c in columns], probs, accuracy, close, stats, [] if scans is None else scans)
    return {c: found[inner[c]] for c in columns}


def _quantiles(df: DataFrame, columns: list[str], probs: list[float], accuracy: int, close: int, stats: dict | None,
               scans: list) -> dict[str, list[float | None]]:
    kinds = {c: "long" if isinstance(df.schema[c].dataType, IntegralType) else "double" for c in columns}
    used = [c for c in dict.fromkeys(columns) if stats is None or stats[c][0]]
    # NaN counts as missing (pandas semantics); Spark would order it above every value.
    data = df.select(*[F.col(c).cast("long").alias(c) if kinds[c] == "long" else F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
                       for c in used])
    finite = data.select(*[F.col(c) if kinds[c] == "long" else F.when(F.abs(c) < math.inf, F.col(c)).alias(c) for c in used])
    points = sorted({min(1.0, max(0.0, p + e * 2 / accuracy)) for p in probs for e in (-1, 1)})
    plan: dict[str, list] = {c: [None] * len(probs) for c in columns}
    targets: dict[tuple[str, int], _Target] = {}
    if used:
        aggs = []
        for k, c in enumerate(used):
            held = F.col(c) if kinds[c] == "long" else F.when(F.abs(c) < math.inf, F.col(c))
            ends = [F.lit(0), F.lit(0)] if kinds[c] == "long" else [F.count_if(F.col(c) == F.lit(e)) for e in (-math.inf, math.inf)]
            aggs += [F.count(c).alias(f"n{k}"), ends[0].alias(f"lo{k}"), ends[1].alias(f"hi{k}"),
                     F.percentile_approx(held, points, accuracy).alias(f"q{k}")]
        row = data.agg(*aggs).first()
        scans.append("sketch")
        for k, c in enumerate(used):
            n, low, high = row[f"n{k}"], row[f"lo{k}"], row[f"hi{k}"]
            for j, p in enumerate(probs if n else []):
                h = (n - 1) * p
                ends = []
                for rank in (math.floor(h), math.ceil(h)):
                    if rank < low or rank >= n - high:
                        ends.append(_Target(c, 0, 0, value=-math.inf if rank < low else math.inf))
                        continue
                    t = targets.get((c, rank))
                    if t is None:
                        t = targets[c, rank] = _Target(c, rank - low, n - low - high)
                        if t.rows > close and not low + high:
                            _bracket(t, points, row[f"q{k}"], p, accuracy, kinds[c])
                            t.rows = math.ceil(n * 4 * t.margin / accuracy)
                    ends.append(t)
                plan[c][j] = (*ends, h - math.floor(h))
    open_targets = list(targets.values())
    while open_targets:
        wide = [t for t in open_targets if t.rows > close]
        if wide:
            _sketch_again(finite, wide, kinds, accuracy)
        else:
            _close(finite, open_targets, kinds, accuracy)
        scans.append("sketch" if wide else "count")
        open_targets = [t for t in open_targets if t.value is None]

    def value(entry):
        if entry is None:
            return None
        a, b, share = entry[0].value, entry[1].value, entry[2]
        out = a if share == 0 or a == b else a + share * (b - a) if math.isfinite(a) and math.isfinite(b) else a * (1 - share) + b * share
        return out if isinstance(out, int) and abs(out) > 1 << 53 else float(out)

    return {c: [value(e) for e in plan[c]] for c in columns}


def exact_median(df: DataFrame, column: str) -> float | None:
    return exact_quantiles(df, [column], [0.5])[column][0]


def approx_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                     accuracy: int = 10000) -> dict[str, list[float | None]]:
    """``percentile_approx`` variant for when a bounded rank error is acceptable."""
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(c)
                   for c in columns]).first()
    return {c: (list(row[c]) if row[c] is not None else [None] * len(probs)) for c in columns}


def value_frequencies(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values with their counts (partial aggregation per task)."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def modes(df: DataFrame, columns: list[str]) -> dict:
    """Mode of several columns in ONE job: ``{column: (value, count)}`` (None if all NULL).

    Values of every column are stacked as (column, numeric value, text value),
    counted per distinct value with map-side combine, then ``min_by`` picks the
    value with the largest count (ties → smallest value, numerically for numeric
    columns).  ``min_by`` keeps one running candidate per column, so a
    high-cardinality column never builds a map in one task.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    rows, at = by_position(df)
    entries = []
    for c in columns:
        numeric, whole = isinstance(types[c], NumericType), isinstance(types[c], IntegralType)
        entries.append(F.struct(F.lit(c).alias("k"),
                                (at[c].cast("double") if numeric and not whole else F.lit(None).cast("double")).alias("num"),
                                (at[c].cast("long") if whole else F.lit(None).cast("long")).alias("int"),
                                at[c].cast("string").alias("txt")))
    stacked = rows.select(F.explode(F.array(*entries)).alias("s")).select("s.*").where(F.col("txt").isNotNull())
    counts = stacked.groupBy("k", "num", "int", "txt").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("k").agg(F.min_by(F.struct("num", "int", "txt", "n"),
                                            F.struct((-F.col("n")).alias("neg"), "num", "int", "txt")).alias("b"))
    found = {r["k"]: r["b"] for r in best.collect()}
    out = {}
    for c in columns:
        b = found.get(c)
        if b is None:
            out[c] = None
            continue
        t = types[c]
        if isinstance(t, NumericType):
            value = b["int"] if isinstance(t, IntegralType) else b["num"]
        else:
            value = b["txt"]
        out[c] = (value, int(b["n"]))
    return out


def mode_row(df: DataFrame, column: str):
    """Most frequent non-null value; ties go to the smallest value.

    Aggregated counts then a distributed top-1 (``TakeOrderedAndProject``): no
    single-task map of distinct values.  Returns ``(value, count)`` or None.
    """
    row = (value_frequencies(df, column)
           .orderBy(F.desc("count"), F.asc(column)).limit(1).first())
    return None if row is None else (row[column], int(row["count"]))
