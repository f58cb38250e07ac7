"""Feature preparation: imputation, one-hot encoding, target mapping, min-max scaling.

Fitting (statistics, category lists, min/max) is one distributed aggregation
whose small result is kept on the driver as a parameter object; applying is a
pure projection, so imputation, encoding and scaling collapse into a single
``Project`` inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tabwise.errors import PipelineError
from tabwise.functions.columns import by_position, dummy_name, nan_as_null, quoted
from tabwise.operators.quantiles import exact_quantiles, modes

MAX_CATEGORIES = 10_000


# --------------------------------------------------------------------------- T1
@dataclass
class ImputeStats:
    values: dict = field(default_factory=dict)   # column -> fill value
    kinds: dict = field(default_factory=dict)    # column -> "mode" | "median"


def fit_impute(df: DataFrame, mode_cols: list[str] = (), median_cols: list[str] = ()) -> ImputeStats:
    """Mode for ``mode_cols`` (ties → smallest), exact median for ``median_cols``.

    Statistics are computed over all rows given (the reference fits them before
    the split; pass only training rows for a leakage-free variant).
    """
    stats = ImputeStats()
    df = nan_as_null(df, [*mode_cols, *median_cols])
    found = modes(df, list(mode_cols)) if mode_cols else {}
    for c in mode_cols:
        m = found[c]
        if m is None:
            raise PipelineError(f"Cannot calculate a mode for `{c}`.")
        stats.values[c], stats.kinds[c] = m[0], "mode"
    if median_cols:
        med = exact_quantiles(df, list(median_cols), [0.5])
        for c in median_cols:
            if med[c][0] is None:
                raise PipelineError(f"Cannot calculate the median for `{c}`.")
            stats.values[c], stats.kinds[c] = med[c][0], "median"
    return stats


def apply_impute(df: DataFrame, stats: ImputeStats) -> DataFrame:
    """Fill NULL and NaN with the fitted values."""
    df = nan_as_null(df, list(stats.values))
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        if c in stats.values:
            value = stats.values[c]
            target = types[c]
            if stats.kinds[c] == "median" and isinstance(target, NumericType) \
                    and target.typeName() not in ("double", "float"):
                target = "double"  # a median of integers may be fractional
            out.append(F.coalesce(quoted(c).cast(target), F.lit(value).cast(target)).alias(c))
        else:
            out.append(quoted(c))
    return df.select(out)


def impute(df: DataFrame, mode_cols: list[str] = (), median_cols: list[str] = ()):
    stats = fit_impute(df, mode_cols, median_cols)
    return apply_impute(df, stats), stats


# --------------------------------------------------------------------------- T2 / T8
@dataclass
class OneHotModel:
    categories: dict  # column -> sorted list of non-null values

    def feature_names(self, df_columns: list[str]) -> list[str]:
        keep = [c for c in df_columns if c not in self.categories]
        return keep + [dummy_name(c, v) for c, vals in self.categories.items() for v in vals]


def fit_one_hot(df: DataFrame, columns: list[str], max_categories: int = MAX_CATEGORIES) -> OneHotModel:
    """Sorted distinct non-null values per column, in ONE aggregation with a bound.

    ``collect_set`` per column is partially aggregated per task; the bound is
    checked first with ``approx_count_distinct`` so an id-like column errors out
    instead of flooding the driver.  More categories than a table can have columns
    go into sparse vectors: ``encoding.fit_categories``.
    """
    if not columns:
        return OneHotModel({})
    rows, at = by_position(df)
    approx = rows.agg(*[F.approx_count_distinct(at[c]) for c in columns]).first()
    wide = [c for c, found in zip(columns, approx) if found > max_categories * 1.1]
    if wide:
        raise PipelineError(f"Too many categories to one-hot encode: {wide}")
    row = rows.agg(*[F.array_sort(F.collect_set(at[c])) for c in columns]).first()
    cats = {}
    for c, found in zip(columns, row):
        vals = list(found)
        if len(vals) > max_categories:
            raise PipelineError(f"Too many categories to one-hot encode `{c}`: {len(vals)}")
        cats[c] = vals
    return OneHotModel(cats)


def one_hot_columns(model: OneHotModel, available: dict[str, Column]) -> list[Column]:
    cols = []
    for c, vals in model.categories.items():
        for v in vals:
            name = dummy_name(c, v)
            if c not in available:
                cols.append(F.lit(0).alias(name))  # absent raw column → zeros (score time)
            else:
                cols.append(F.when(available[c] == F.lit(v), F.lit(1)).otherwise(F.lit(0)).alias(name))
    return cols


def apply_one_hot(df: DataFrame, model: OneHotModel) -> DataFrame:
    """Other columns first (original order), then each column's dummies in sorted order.

    NULL and categories unseen at fit time give all zeros (score-time encoding).
    Dummies may differ only in case; such columns are reached by position (``by_position``).
    """
    rows, at = by_position(df)
    keep = [at[c].alias(c) for c in df.columns if c not in model.categories]
    return rows.select(*keep, *one_hot_columns(model, at))


def one_hot(df: DataFrame, columns: list[str], max_categories: int = MAX_CATEGORIES):
    model = fit_one_hot(df, columns, max_categories)
    return apply_one_hot(df, model), model


# --------------------------------------------------------------------------- P4 / P5
def threshold_class(df: DataFrame, column: str, threshold: float, out_col: str | None = None) -> DataFrame:
    """``column >= threshold`` → 1 else 0 (inclusive boundary; NULL → 0)."""
    out_col = out_col or column
    expr = F.coalesce(F.col(column) >= F.lit(threshold), F.lit(False)).cast("int")
    return df.withColumn(out_col, expr)


def map_target(df: DataFrame, column: str, mapping: dict, out_col: str | None = None,
               check: bool = True) -> DataFrame:
    """Map values through ``mapping``; any other value (or NULL) is an error listing them."""
    out_col = out_col or column
    expr = None
    for k, v in mapping.items():
        expr = F.when(F.col(column) == F.lit(k), F.lit(v)) if expr is None \
            else expr.when(F.col(column) == F.lit(k), F.lit(v))
    if check:
        bad = df.where(~F.col(column).isin(list(mapping.keys())) | F.col(column).isNull()).select(column).distinct()
        total = bad.count()
        if total:
            first = [r[0] for r in bad.orderBy(F.asc_nulls_first(column)).limit(20).collect()]
            raise PipelineError(f"{total} value(s) of `{column}` have no mapping (known: {list(mapping)}); "
                                f"in order, the first of them: {first}")
    return df.withColumn(out_col, expr)


def relabel(df: DataFrame, column: str, names: dict, out_col: str | None = None) -> DataFrame:
    """P10: replace codes by display names (unmapped values keep their text)."""
    out_col = out_col or column
    expr = F.col(column).cast("string")
    for k, v in names.items():
        expr = F.when(F.col(column) == F.lit(k), F.lit(v)).otherwise(expr)
    return df.withColumn(out_col, expr)


# --------------------------------------------------------------------------- T5
@dataclass
class MinMaxModel:
    mins: dict
    maxs: dict

    def renamed(self, names: dict) -> MinMaxModel:
        return MinMaxModel({names.get(c, c): v for c, v in self.mins.items()}, {names.get(c, c): v for c, v in self.maxs.items()})

    def table_rows(self) -> list[tuple]:
        return [(c, self.mins[c], self.maxs[c]) for c in self.mins]


def fit_minmax(train: DataFrame, columns: list[str]) -> MinMaxModel:
    rows, at = by_position(train)
    values = [at[c].cast("double") for c in columns]
    row = rows.agg(*[F.min(v).alias(f"mn{i}") for i, v in enumerate(values)],
                    *[F.max(v).alias(f"mx{i}") for i, v in enumerate(values)]).first()
    return MinMaxModel({c: row[f"mn{i}"] for i, c in enumerate(columns)}, {c: row[f"mx{i}"] for i, c in enumerate(columns)})


def minmax_expr(value: Column, c: str, model: MinMaxModel) -> Column:
    """(x - min) / (max - min); a constant column keeps range 1 (x - min); no clipping."""
    mn, mx = model.mins[c], model.maxs[c]
    rng = (mx - mn) if (mx is not None and mn is not None and mx != mn) else 1.0
    return ((value.cast("double") - F.lit(mn)) / F.lit(rng)).alias(c)


def apply_minmax(df: DataFrame, model: MinMaxModel) -> DataFrame:
    rows, at = by_position(df)
    return rows.select([minmax_expr(at[c], c, model) if c in model.mins else at[c].alias(c) for c in df.columns])
