"""Sinks: CSV and JSON exports, and versions of a table switched atomically."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """Header, every field quoted, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object per line, null members kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_version(df: DataFrame, root: str, version: str) -> str:
    """A new directory per version; readers switch when the pointer row is written last."""
    path = f"{root}/v={version}"
    df.write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    first = not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_pointer"))
    number = 1 if first else 1 + (_pointers(spark, root).agg({"number": "max"}).first()[0] or 0)
    spark.createDataFrame([(version, number)], _POINTER).coalesce(1).write.mode("append").json(f"{root}/_pointer")
    return path


_POINTER = "version string, number long"


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_POINTER).json(f"{root}/_pointer")


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The version written last, by the number of its pointer."""
    top = _pointers(spark, root).agg(F.max_by("version", "number")).first()[0]
    return spark.read.parquet(f"{root}/v={top}")


def replace_all(df: DataFrame, path: str) -> None:
    """The table as df and nothing else (K3)."""
    df.write.mode("overwrite").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a log (K6)."""
    df.write.mode("append").parquet(path)


def json_document(df: DataFrame, order: list[str]) -> DataFrame:
    """(document): all rows, in order, as one JSON document indented by two spaces (K9); for exports that one reader takes whole."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), F.struct(*df.columns).alias("r")))), lambda x: x["r"])
    return df.agg(F.to_json(rows, {"pretty": "true", "ignoreNullFields": "false"}).alias("document"))
