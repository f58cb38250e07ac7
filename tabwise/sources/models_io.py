"""Model sink and source (S7 / S8): a directory per bundle instead of a pickle.

Layout: ``<path>/meta`` (one-row parquet: kind, feature order, JSON extras
such as imputation defaults, scaler min/max, threshold, MLP weights) and,
for Spark ML models, ``<path>/model`` (``PipelineModel`` format).  Forests with
leaf values of their own keep these in ``<path>/leaves``, one row a tree, and
node-table trees their nodes in ``<path>/nodes``.  Loading
checks ``kind`` and raises ``PipelineError`` on a mismatch.  No arbitrary code
is deserialised.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from tabwise.errors import PipelineError
from tabwise.operators.trees import TreeTable


@dataclass
class Bundle:
    kind: str
    features: list[str]
    extras: dict = field(default_factory=dict)
    spark_model: PipelineModel | None = None
    leaves: list[list[float]] | None = None    # by tree and leaf number
    trees: TreeTable | None = None


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> str:
    extras = dict(bundle.extras)
    if bundle.trees is not None:
        extras["_trees"] = {"label": bundle.trees.label, "classes": bundle.trees.classes, "params": bundle.trees.params}
        bundle.trees.table(spark).write.mode("overwrite").parquet(f"{path}/nodes")
    meta = spark.createDataFrame([(bundle.kind, bundle.features, json.dumps(extras, default=str),
                                   bundle.spark_model is not None, bundle.leaves is not None)],
                                 "kind string, features array<string>, extras string, has_model boolean, has_leaves boolean")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    if bundle.spark_model is not None:
        bundle.spark_model.write().overwrite().save(f"{path}/model")
    if bundle.leaves is not None:
        table = spark.createDataFrame(list(enumerate(bundle.leaves)), "tree int, leaf_values array<double>")
        table.write.mode("overwrite").parquet(f"{path}/leaves")
    return path


def load_bundle(spark: SparkSession, path: str, expected_kind: str | None = None) -> Bundle:
    try:
        row = spark.read.parquet(f"{path}/meta").first()
    except Exception as exc:  # noqa: BLE001
        raise PipelineError(f"Could not load a model bundle from {path}: {exc}") from exc
    if row is None:
        raise PipelineError(f"Empty model bundle at {path}")
    if expected_kind is not None and row["kind"] != expected_kind:
        raise PipelineError(f"The bundle at {path} is a `{row['kind']}` model, not `{expected_kind}`.")
    model = PipelineModel.load(f"{path}/model") if row["has_model"] else None
    leaves = None
    if "has_leaves" in row and row["has_leaves"]:
        table = spark.read.parquet(f"{path}/leaves").orderBy("tree")
        leaves = [r["leaf_values"] for r in table.collect()]     # one row a tree
    features, extras = list(row["features"]), json.loads(row["extras"])
    trees = None
    if "_trees" in extras:
        trees = TreeTable.from_table(spark.read.parquet(f"{path}/nodes"), features, **extras.pop("_trees"))
    return Bundle(row["kind"], features, extras, model, leaves, trees)
