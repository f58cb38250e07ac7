import os

import pytest
from pyspark.sql import functions as F

from tabwise.errors import PipelineError
from tabwise.operators import cluster as CL
from tabwise.sources import coerce_and_reject, read_csv, require_columns, require_numeric, write_table
from tabwise.sources.models_io import Bundle
from tabwise.operators.scoring import assign_clusters
from tabwise.streaming.scoring import score_stream, stream_source


def _csv(tmp_dir, text, name="d.csv"):
    path = os.path.join(tmp_dir, name)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


def test_csv_na_tokens_bom_crlf_and_inference(spark, tmp_dir):
    path = _csv(tmp_dir, "﻿id,score,name\r\n1,2.5,a\r\n2,NA,N/A\r\n3,,b\r\n4,7,null\r\n")
    df = read_csv(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "score": "double", "name": "string"}
    rows = df.orderBy("id").collect()
    assert [r.score for r in rows] == [2.5, None, None, 7.0]
    assert [r.name for r in rows] == ["a", None, "b", None]


def test_required_and_numeric_checks(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(PipelineError) as e:
        require_columns(df, ["a", "c", "d"])
    assert "['c', 'd']" in str(e.value)
    with pytest.raises(PipelineError) as e:
        require_numeric(df)
    assert "b" in str(e.value)


def test_coerce_and_reject_names_bad_columns(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "3")], "a string, b string")
    assert coerce_and_reject(df, ["a"]).dtypes[0] == ("a", "double")
    with pytest.raises(PipelineError) as e:
        coerce_and_reject(df, ["a", "b"])
    assert "['b']" in str(e.value)


def test_stream_scoring_available_now(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    rows = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0)], "id int, a double, b double")
    write_table(rows, src)
    bundle = Bundle("kmeans", ["a", "b"], {"centres": [[0.0, 0.0], [9.0, 9.0]]})
    stream = stream_source(spark, src, rows.schema)
    q = score_stream(stream, lambda d: assign_clusters(d, bundle), os.path.join(tmp_dir, "out"),
                     os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination()
    got = {r.id: r.Cluster for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect()}
    assert got == {1: 0, 2: 1}
