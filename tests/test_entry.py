import duckdb
import pytest

import __spark_entry__ as E
from tabwise.sources.tables import TABLE_NAMES
from tests.conftest import SF_SMALL

ORACLE_FAST = ["null_report", "describe_numeric", "value_counts", "class_shares", "corr_pearson",
               "corr_spearman", "histogram_30", "density_grid", "impute_mode_median", "one_hot",
               "stratified_split", "split_report", "kfold_ids", "stratified_kfold_ids",
               "threshold_sweep_metrics", "silhouette", "assign_nearest_center", "segment_names",
               "orders_slice", "minmax_train_only", "cv_score_summary", "central_tendency",
               "class_names", "first_test_row", "null_report_before_after", "processed_table_sink",
               "score_time_encoding", "mae_baseline", "describe_strings", "catalog_counts",
               "ols_fit", "ols_two_features", "kfold_ids_unshuffled", "corr_spearman_gaps",
               "tree_root_cuts", "describe_all", "scatter_matrix", "category_dictionary", "sparse_one_hot"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["split", "o_orderstatus", "n", "share", "mean_totalprice", "urgent_share"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _canon(rows):
    def norm(v):
        return float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted((tuple(norm(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ORACLE_FAST)
def test_query_matches_sql_twin_on_small_tables(spark, name):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    idx = [ocols.index(c) for c in cols]
    want = [tuple(r[i] for i in idx) for r in res.fetchall()]
    assert sorted(ocols) == cols
    assert _canon(got) == _canon(want)
