"""Reading and writing record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    index_col: str | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """A parquet or CSV table; blank strings stay ``''`` rather than NULL.

    ``index_col`` (CSV: the unnamed first column by default when it has no
    header) becomes ``row_id``.  Give ``schema`` on large CSV input, otherwise
    types cost an extra pass.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    if fmt == "csv":
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        df = reader.csv(path)
        if index_col is None and df.columns and df.columns[0] in ("", "_c0"):
            index_col = df.columns[0]
    else:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = reader.format(fmt).load(path)
    if index_col is not None:
        df = df.withColumnRenamed(index_col, "row_id")
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.na.fill("", strings) if strings else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    writer = df.write.mode(mode)
    if fmt == "csv":
        # Spark writes '' as "" by default, which reads back as a blank.
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def with_row_id(df: DataFrame, *keys: str, out: str = "row_id") -> DataFrame:
    """A row id from a natural key (Spark tables have no row order)."""
    return df.withColumn(out, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
