"""Scalar column functions used across operators.

All helpers return ``Column`` expressions built from ``pyspark.sql.functions``
so they fuse into the surrounding projection; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    FloatType,
    NumericType,
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_numeric(c: str | Column) -> Column:
    """Coerce to double; unparsable text becomes NULL (pandas ``errors='coerce'``)."""
    return _col(c).try_cast("double")


def is_missing(c: str | Column, dtype=None) -> Column:
    """NULL, or NaN for floating columns."""
    col = _col(c)
    if isinstance(dtype, (DoubleType, FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def by_position(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The same rows under positional names, and their columns by exact name (which may differ from another only in case)."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), {c: F.col(n) for c, n in zip(df.columns, names)}


def nan_as_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN becomes NULL in the floating columns of ``columns`` (all if not given)."""
    wanted = set(df.columns if columns is None else columns)
    floating = {f.name for f in df.schema.fields if f.name in wanted and isinstance(f.dataType, (DoubleType, FloatType))}
    if not floating:
        return df
    return df.select([F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floating else quoted(c) for c in df.columns])


def fill_value(c: str | Column, value, dtype=None) -> Column:
    """``fillna`` as ``coalesce`` with a literal of the column's own type."""
    lit = F.lit(value)
    if dtype is not None:
        lit = lit.cast(dtype)
    return F.coalesce(_col(c), lit)


def flag(predicate: Column) -> Column:
    """Boolean to 0/1 int, NULL counted as 0 (pandas compares NaN as False)."""
    return F.coalesce(predicate, F.lit(False)).cast("int")


def share_equal_ci(c: str | Column, value: str) -> Column:
    """Per-row indicator for a case-insensitive string match (for ``avg`` → share)."""
    return flag(F.lower(_col(c).cast("string")) == F.lit(value.lower())).cast("double")


def dummy_name(column: str, value) -> str:
    """Name of a one-hot column: ``<column>_<value>`` with the value's text form."""
    if isinstance(value, float) and value.is_integer():
        text = repr(value)
    else:
        text = str(value)
    return f"{column}_{text}"


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of numeric columns in schema order (``select_dtypes('number')``)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


#: Decimal numbers as plain text: no Java type suffixes (``5f``, ``7d``), which a cast alone would accept.
NUMBER_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def text_to_double(col):
    """A double from number-like text, NULL from anything else."""
    return F.when(col.cast("string").rlike(NUMBER_TEXT), col.try_cast("double"))
