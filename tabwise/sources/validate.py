"""Schema and content checks (required columns, all-numeric, coerce-and-reject)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tabwise.errors import PipelineError
from tabwise.functions.columns import is_missing, quoted, text_to_double


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Error listing every required column absent from ``df`` (no job runs)."""
    present = set(df.columns)
    missing = [c for c in required if c not in present]
    if missing:
        raise PipelineError(f"Required columns are missing: {missing}")
    return df


def require_numeric(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Error naming every non-numeric column (schema only, no job)."""
    bad = [f.name for f in df.schema.fields
           if f.name not in exclude and not isinstance(f.dataType, NumericType)]
    if bad:
        raise PipelineError(f"All columns must be numeric; non-numeric columns found: {bad}")
    return df


def null_counts(df: DataFrame, columns: list[str] | None = None) -> dict[str, int]:
    """NULL/NaN count per column from ONE aggregation pass."""
    columns = columns or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    row = df.agg(*[F.count_if(is_missing(c, types[c])).alias(c) for c in columns]).first()
    return {c: int(row[c]) for c in columns}


def coerce_and_reject(df: DataFrame, columns: list[str]) -> DataFrame:
    """``to_numeric(errors='coerce')`` on ``columns`` then fail if any became/was NULL."""
    coerced = df.select([
        text_to_double(quoted(c)).alias(c) if c in columns else quoted(c) for c in df.columns
    ])
    counts = null_counts(coerced, columns)
    bad = [c for c in columns if counts[c] > 0]
    if bad:
        raise PipelineError(f"These columns contain missing/non-numeric values: {bad}")
    return coerced
