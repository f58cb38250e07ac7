"""Column-expression helpers (JVM-side, codegen-friendly)."""

from tabwise.functions.columns import (
    dummy_name,
    fill_value,
    flag,
    is_missing,
    numeric_columns,
    share_equal_ci,
    to_numeric,
)

__all__ = ["dummy_name", "fill_value", "flag", "is_missing", "numeric_columns",
           "share_equal_ci", "to_numeric"]
