"""Batch scoring of raw records with a saved bundle.

The one-row prediction forms of the original become DataFrame → DataFrame
transforms: stored category lists re-encode raw columns (unseen or absent →
zeros), stored min/max rescale them, and the model adds probability and
class columns.  All steps are projections, so they also run unchanged on a
streaming DataFrame.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.errors import PipelineError
from tabwise.functions.columns import by_position, dummy_name
from tabwise.operators import cluster as CL
from tabwise.operators import mlp as MLP
from tabwise.operators import models as MO
from tabwise.operators import prep as PR
from tabwise.operators.metrics import predicted_class
from tabwise.sources.models_io import Bundle


def _text(value) -> str | None:
    """A category as Spark writes it."""
    return str(value).lower() if isinstance(value, bool) else None if value is None else str(value)


def encode_raw(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Rebuild the training feature columns from raw columns; missing values take the training defaults, else 0."""
    rows, at = by_position(df)
    cats = bundle.extras.get("categories", {})
    onehot = PR.OneHotModel({c: list(v) for c, v in cats.items()})
    defaults = bundle.extras.get("defaults") or {}
    enc = {}
    for c, vals in onehot.categories.items():
        for v in vals:
            name = dummy_name(c, v)
            if c not in at:
                enc[name] = F.lit(0)
                continue
            value = F.coalesce(at[c].cast("string"), F.lit(_text(defaults.get(c))))
            enc[name] = F.when(value == F.lit(_text(v)), F.lit(1)).otherwise(F.lit(0))
    out = []
    for f in bundle.features:
        if f in enc:
            out.append(enc[f].cast("double").alias(f))
        elif f in at:
            number = F.nanvl(at[f].cast("double"), F.lit(None).cast("double"))
            out.append(F.coalesce(number, F.lit(float(defaults.get(f) or 0.0))).alias(f))
        else:
            out.append(F.lit(0.0).alias(f))
    keep = [at[c].alias(c) for c in df.columns if c not in bundle.features]
    return rows.select(*keep, *out)


def _scale(df: DataFrame, bundle: Bundle) -> DataFrame:
    mins, maxs = bundle.extras.get("mins"), bundle.extras.get("maxs")
    if mins is None:
        return df
    return PR.apply_minmax(df, PR.MinMaxModel(mins, maxs))


def score_classifier(df: DataFrame, bundle: Bundle, threshold: float = 0.5) -> DataFrame:
    """Encode → scale → P(class 1) → class with the inclusive ``>=`` rule."""
    if bundle.spark_model is None and bundle.trees is None:
        raise PipelineError("This bundle has no model to score with")
    ready = _scale(encode_raw(df, bundle), bundle)
    out = (bundle.trees or MO.FittedModel(bundle.kind, bundle.spark_model, bundle.features, "label")).transform(ready)
    out = out.withColumn("probability_1", vector_to_array("probability")[1])
    return out.withColumn("predicted_class", predicted_class("probability_1", threshold)) \
        .drop("features", "rawPrediction", "probability", "prediction")


def score_mlp(df: DataFrame, bundle: Bundle) -> DataFrame:
    """As X2 with the network; the stored target threshold is informative only."""
    ready = _scale(encode_raw(df, bundle), bundle)
    model = MLP.MLPModel(bundle.extras["theta"], len(bundle.features), tuple(bundle.extras["hidden"]),
                         bundle.extras["activation"])
    rows, at = by_position(ready)
    arr = rows.select("*", F.array(*[at[c] for c in bundle.features])).toDF(*ready.columns, "_x")
    return MLP.predict_mlp(arr, model, "_x", 0.5, inclusive=True, prob_col="probability_1",
                           pred_col="predicted_class").drop("_x")


def score_regressor(df: DataFrame, bundle: Bundle, out_col: str = "prediction") -> DataFrame:
    """The stored linear model's or forest's prediction beside the given columns; absent and NULL features are 0.0.

    A projection: rows are not joined, so repeated ids and streams are fine.
    """
    if bundle.spark_model is None and bundle.trees is None:
        raise PipelineError("This bundle has no model to score with")
    rows, at = by_position(df)
    given = F.struct(*[at[c].alias(c) for c in df.columns]).alias("_given")
    ready = rows.select(given, *[at[c].alias(c) for c in bundle.features if c in at])
    fitted = MO.FittedModel(bundle.kind, bundle.spark_model, bundle.features, "label")
    scored = (bundle.trees or MO.LeafMedianForest(fitted, bundle.leaves)).transform(ready)
    scored = scored.select("_given", "prediction")
    return scored.select("_given.*", "prediction").toDF(*df.columns, out_col)


def assign_clusters(df: DataFrame, bundle: Bundle, out_col: str = "Cluster") -> DataFrame:
    """Nearest stored centre."""
    return CL.assign_nearest(df, bundle.features, bundle.extras["centres"], out_col=out_col, dist_col=None)
