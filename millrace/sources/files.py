"""Reading tables by suffix, and writing results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.functions.selectors import DATES, col
from millrace.sources.jsonrecords import read_json


def _widened(df: DataFrame) -> DataFrame:
    """Inferred 32-bit numbers as 64-bit ones, which the core statistics look at."""
    wide = {T.IntegerType: "long", T.ShortType: "long", T.ByteType: "long", T.FloatType: "double"}
    return df.select(*[(col(f.name).cast(wide[type(f.dataType)]) if type(f.dataType) in wide else col(f.name)).alias(f.name) for f in df.schema])


def load_data(file_path: str, spark: SparkSession | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A table from ``.csv``, ``.tsv``, ``.json`` (one record, an array of records, or records one after the other) or ``.parquet``.

    CSV and TSV have a header; CSV dates are parsed, TSV dates stay strings. With ``schema`` nothing is inferred, which
    spares a pass over the data.
    """
    if file_path.endswith((".xlsx", ".xls")):
        raise ValueError("Excel files are not read; convert them to CSV or Parquet.")
    if not file_path.endswith((".csv", ".tsv", ".json", ".parquet")):
        raise ValueError("Unsupported file format")
    spark = spark or SparkSession.builder.getOrCreate()
    if file_path.endswith(".parquet"):
        return (spark.read.schema(schema) if schema else spark.read).parquet(file_path)
    if file_path.endswith(".json"):
        return read_json(spark, file_path, schema)
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("sep", "\t" if file_path.endswith(".tsv") else ",")
    if schema:
        return reader.schema(schema).csv(file_path)
    df = reader.option("inferSchema", True).csv(file_path)
    if file_path.endswith(".tsv"):
        texts = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, DATES) else f.dataType, True) for f in df.schema])
        df = reader.schema(texts).csv(file_path)
    return _widened(df)


def quantized(df: DataFrame) -> DataFrame:
    """Floats as 32-bit floats and integers as 32-bit integers; a number that does not fit is an error."""
    small = {T.DoubleType: "float", T.LongType: "int"}
    return df.select(*[(col(f.name).cast(small[type(f.dataType)]) if type(f.dataType) in small else col(f.name)).alias(f.name) for f in df.schema])


def save_cleaned_data(df: DataFrame, file_name: str = "cleaned_data.csv", quantize: bool = True, single_file: bool = False) -> DataFrame:
    """Write ``df`` as CSV (or Parquet, by suffix) and return what was written. One file only on demand: that is one task."""
    out = quantized(df) if quantize else df
    writer = (out.coalesce(1) if single_file else out).write.mode("overwrite")
    writer.parquet(file_name) if file_name.endswith(".parquet") else writer.option("header", True).csv(file_name)
    return out


def save_dashboard(html: str, filename: str = "dashboard.html", folder: str = "output/eda") -> str:
    """Write the report (a small text) on the driver; returns its path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, filename)
    with open(path, "w", encoding="utf-8") as out:
        out.write(html)
    return path


__all__ = ["load_data", "quantized", "save_cleaned_data", "save_dashboard"]
