"""Sources and sinks: parquet tables, validated CSV ingest, table and model sinks."""

from tabwise.sources.csv import read_csv
from tabwise.sources.tables import TABLE_NAMES, catalog_counts, read_table
from tabwise.sources.validate import (
    coerce_and_reject,
    require_columns,
    require_numeric,
)
from tabwise.sources.sinks import write_table

__all__ = ["TABLE_NAMES", "catalog_counts", "coerce_and_reject", "read_csv", "read_table",
           "require_columns", "require_numeric", "write_table"]
