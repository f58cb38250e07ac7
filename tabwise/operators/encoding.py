"""One-hot encoding with a category dictionary: a table of categories and sparse vectors, for any number of them.

``prep.one_hot`` makes a column per category, which suits a few thousand.  Here
the categories of all columns are rows of a written table with their vector
index, so nothing grows on the driver, in a task or in the plan with their
number.  Rows look their index up by a join in which no value is hot: values
that hold more than 1/1024 of a column's rows (fewer than 1,024 by definition)
come from a broadcast, only the other rows are joined by value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, FractionalType, IntegralType, StructField, StructType

from tabwise.errors import PipelineError
from tabwise.functions.columns import by_position
from tabwise.operators.ranking import ordered_totals
from tabwise.session import materialize

HOT_SHARE = 1024      # a category is hot if it has more than one in so many rows of its column


@dataclass
class CategoryDictionary:
    """``entries (k, category, place, n, hot)``: the column's number, the value as text, its index among all
    columns' categories (by column, then value), its rows at fit time, and whether it is hot."""

    columns: list[str]
    entries: DataFrame
    sizes: list[int]      # categories a column
    cold: list[int]       # of these, the ones that are not hot

    @property
    def width(self) -> int:
        return sum(self.sizes)

    def save(self, path: str) -> str:
        spark = self.entries.sparkSession
        self.entries.write.mode("overwrite").parquet(f"{path}/entries")
        columns = spark.createDataFrame(list(enumerate(self.columns)), "k int, name string")
        columns.coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> CategoryDictionary:
        columns = [r["name"] for r in spark.read.parquet(f"{path}/columns").orderBy("k").collect()]
        return _dictionary(columns, spark.read.parquet(f"{path}/entries"))


def _dictionary(columns: list[str], entries: DataFrame) -> CategoryDictionary:
    found = {r["k"]: r for r in entries.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.count_if(~F.col("hot")).alias("cold")).collect()}
    size, cold = ([int(found[k][name]) if k in found else 0 for k in range(len(columns))] for name in ("size", "cold"))
    return CategoryDictionary(list(columns), entries, size, cold)


def _category(column: Column, kind: DataType) -> Column:
    """The value as text; NULL and NaN are no category, and -0.0 is 0.0."""
    if isinstance(kind, FractionalType) and kind.typeName() != "decimal":
        column = F.when(~F.isnan(column), column + F.lit(0.0).cast(kind))
    return column.cast("string")


def fit_categories(df: DataFrame, columns: list[str]) -> CategoryDictionary:
    """The dictionary of ``columns``: integers and reals in numeric order, all else in text order.

    One aggregation by (column, value) with map-side combine, so a hot value is one
    row a task, then a range-partitioned numbering.  A column without values, and an
    empty table, have no entries.
    """
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise PipelineError(f"No such columns to encode: {absent}")
    rows, at = by_position(df)
    kinds = {c: df.schema[c].dataType for c in columns}

    def cell(k: int, c: str) -> Column:
        whole = at[c].cast("decimal(20,0)") if isinstance(kinds[c], IntegralType) else F.lit(None).cast("decimal(20,0)")
        real = at[c].cast("double") if isinstance(kinds[c], FractionalType) else F.lit(None).cast("double")
        return F.struct(F.lit(k).alias("k"), whole.alias("whole"), real.alias("real"), _category(at[c], kinds[c]).alias("category"))

    spark = df.sparkSession
    if not columns:
        return CategoryDictionary([], spark.createDataFrame([], "k int, category string, place long, n long, hot boolean"), [], [])
    cells = rows.select(F.explode(F.array(*[cell(k, c) for k, c in enumerate(columns)])).alias("cell")).select("cell.*")
    counts = (cells.where("category IS NOT NULL").groupBy("k", "category")
              .agg(F.min("whole").alias("whole"), F.min("real").alias("real"), F.count(F.lit(1)).alias("n")))
    placed = materialize(ordered_totals(counts, [F.col(c) for c in ("k", "whole", "real", "category")], F.lit(1), "place"), spread=False)
    totals = placed.groupBy("k").agg(F.sum("n").alias("_all"))      # one row a column
    entries = placed.join(F.broadcast(totals), "k").select("k", "category", "place", "n", (F.col("n") * HOT_SHARE > F.col("_all")).alias("hot"))
    return _dictionary(columns, materialize(entries, spread=False))


def category_places(df: DataFrame, dictionary: CategoryDictionary, out_col: str = "places") -> DataFrame:
    """Add ``out_col``: ascending indices of the row's categories; missing values, unseen ones and absent columns have none.

    Rows whose value is missing or hot get a salt instead of a join key, so they are
    not gathered either.  (A value unseen at fit time may be hot among the rows to
    encode; that partition is split by Spark's adaptive skew join.)
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows, at = by_position(df)
    given, places = rows.columns, []
    for k, c in enumerate(dictionary.columns):
        if c not in at or not dictionary.sizes[k]:
            continue
        own = dictionary.entries.where(F.col("k") == k)
        text, place = _category(at[c], kinds[c]), F.lit(None).cast("long")
        if dictionary.cold[k] < dictionary.sizes[k]:
            hot = own.where("hot").select(F.col("category").alias("_hc"), F.col("place").alias(f"_hot{k}"))
            rows = rows.join(F.broadcast(hot), text == F.col("_hc"), "left").drop("_hc")
            place = F.col(f"_hot{k}")
        if dictionary.cold[k]:
            rows = rows.withColumn("_key", F.when(place.isNull(), text))
            rows = rows.withColumn("_salt", F.when(F.col("_key").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(HOT_SHARE)) + 1)
                                   .otherwise(F.lit(0)).cast("long"))
            rest = own.where("NOT hot").select(F.col("category").alias("_cc"), F.lit(0).cast("long").alias("_cs"), F.col("place").alias(f"_cold{k}"))
            rows = rows.join(rest, (F.col("_key") == F.col("_cc")) & (F.col("_salt") == F.col("_cs")), "left").drop("_key", "_salt", "_cc", "_cs")
            place = F.coalesce(place, F.col(f"_cold{k}"))
        places.append(place.cast("int"))
    found = F.array_compact(F.array(*places)) if places else F.array().cast("array<int>")
    return rows.select(*given, found.alias("_places")).toDF(*df.columns, out_col)


def sparse_one_hot(df: DataFrame, dictionary: CategoryDictionary, numeric: list[str] = (), out_col: str = "features") -> DataFrame:
    """Add ``out_col``: a SparseVector of the ``numeric`` columns (missing or absent: 0), then one place per category."""
    rows, at = by_position(category_places(df, dictionary, "_places"))
    numbers = [F.coalesce(F.nanvl(at[c].cast("double"), F.lit(0.0)), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in numeric]
    places = at["_places"]
    cells = [F.struct(F.lit(i).alias("i"), x.alias("x")) for i, x in enumerate(numbers)]
    dummies = F.transform(places, lambda p: F.struct((p + F.lit(len(numbers))).alias("i"), F.lit(1.0).alias("x")))
    cells = F.filter(F.concat(F.array(*cells), dummies) if cells else dummies, lambda cell: cell["x"] != 0.0)
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(len(numbers) + dictionary.width).alias("size"),
                      F.transform(cells, lambda cell: cell["i"]).alias("indices"), F.transform(cells, lambda cell: cell["x"]).alias("values"))
    # There is no cast from a struct to a vector; Spark's JSON reader builds vectors from the same fields.
    read = F.from_json(F.to_json(F.struct(vector.alias("v"))), StructType([StructField("v", VectorUDT())]))["v"]
    return rows.select(*rows.columns[:-1], read.alias("_vector")).toDF(*df.columns, out_col)


def feature_names(dictionary: CategoryDictionary, numeric: list[str] = ()) -> DataFrame:
    """(place, feature): the vector's numeric columns, then ``<column>_<category>``."""
    spark = dictionary.entries.sparkSession
    columns = spark.createDataFrame(list(enumerate(dictionary.columns)), "k int, name string")
    numbers = spark.createDataFrame([(i, c) for i, c in enumerate(numeric)], "place long, feature string")
    dummies = dictionary.entries.join(F.broadcast(columns), "k").select((F.col("place") + len(numeric)).alias("place"),
                                                                        F.concat_ws("_", "name", "category").alias("feature"))
    return numbers.unionByName(dummies)
