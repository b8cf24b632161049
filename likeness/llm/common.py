"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from likeness.plans.materialise import store

# Words are separated by these six ASCII characters, never by other Unicode space.
SPACE = r"[\x20\x09-\x0D]+"

# Rows that a Python task unpacks at a time.
SLICE_ROWS = 500

# Rows of one key that a window sorts in one task are cut into this many parts.
PARTS = 4096


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    return store(df).df


def text_of(col: str | Column) -> Column:
    """A text, with NULL read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def map_rows(df: DataFrame, make: Callable[[dict[str, list]], dict], schema: str) -> DataFrame:
    """``make`` turns a batch of columns, as lists, into the columns of ``schema``.

    Unlike pandas columns, lists keep large integers beside NULLs exact.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batches(parts):
        for part in parts:
            # A batch may hold many megabytes of text: only a slice of it is unpacked at a time.
            for at in range(0, part.num_rows, SLICE_ROWS):
                yield pa.RecordBatch.from_pydict(make(part.slice(at, SLICE_ROWS).to_pydict()), schema=arrow)

    return df.mapInArrow(batches, schema)


def smallest_first(id_col: str, *ties: str) -> Column:
    """A struct whose minimum is the smallest id; NULL ids come last."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *ties)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... without gaps inside each group of ``keys`` (not NULL).

    Any group is cut by a hash of ``order`` into at most ``PARTS`` parts that are
    sorted apart, so the numbers follow no particular order, but a key that
    holds a third of all rows still spreads over all tasks.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int")
    cut = df.withColumn("_part", part)
    sizes = cut.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*keys, "_part").orderBy(*order)
    placed = cut.withColumn("_at", F.row_number().over(inside) - 1)
    return (
        placed.join(starts, [*keys, "_part"])
        .withColumn(out, F.col("_start") + F.col("_at"))
        .drop("_part", "_start", "_at")
    )
