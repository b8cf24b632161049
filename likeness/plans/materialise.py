"""Write a small or reused result once, to reliable shared storage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A join side is broadcast only below this many rows and this many bytes of its
# stored files, both measured when it is written.  Files of wide tables are small for
# what they hold, and the driver unpacks a side it sends: rows times columns are bounded too.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
BROADCAST_VALUES = 4_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediates, shared by the driver and all executors.

    It is the one ``spark.checkpoint.dir`` names.  Where that is unset, a local
    master (one machine) uses a folder in the warehouse; a cluster gets an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    if not path:
        raise RuntimeError(
            "Intermediate tables need spark.checkpoint.dir: set it, when the session is built, "
            "to a folder that the driver and all executors share."
        )
    return path.rstrip("/")


# Names the part of the run's folder that tables go to; a finished part can be dropped by itself.
_SCOPE: ContextVar[str] = ContextVar("scope", default="")


def run_dir(spark: SparkSession, scope: str = "") -> str:
    """The folder below :func:`scratch_dir` that holds this application's tables, or those of one scope."""
    return f"{scratch_dir(spark)}/likeness/{spark.sparkContext.applicationId}" + (f"/{scope}" if scope else "")


@contextmanager
def scoped(name: str) -> Iterator[None]:
    """Tables stored inside go to the scope ``name``."""
    token = _SCOPE.set(name)
    try:
        yield
    finally:
        _SCOPE.reset(token)


def drop_intermediates(spark: SparkSession, scope: str = "") -> None:
    """Delete the tables this application stored (in a scope); frames that read them become invalid."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark, scope))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans nothing refers to any more; it does so after a collection.

    The collection also gives the memory of those plans back, which the driver would keep as heap.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@dataclass(frozen=True)
class Stored:
    """A written table, its measured row count and the bytes of its files."""

    df: DataFrame
    rows: int
    size: int = 0

    @property
    def small(self) -> bool:
        values = self.rows * len(self.df.columns)
        return self.rows <= BROADCAST_ROWS and self.size <= BROADCAST_BYTES and values <= BROADCAST_VALUES


def store(df: DataFrame, path: str | None = None) -> Stored:
    """Write ``df`` as parquet and read it back.

    Unlike an in-memory or executor-local copy this survives lost executors,
    keeps column pruning and pushdown, and cuts the lineage.
    """
    spark = df.sparkSession
    if path is None:
        path = f"{run_dir(spark, _SCOPE.get())}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return load_stored(spark, path)


def load_stored(spark: SparkSession, path: str) -> Stored:
    df = spark.read.parquet(path)
    # Answered from the parquet footers.  (An Observation would count while
    # writing, but a session that holds one can no longer serialise ML models.)
    return Stored(df, df.count(), _bytes(spark, path))


def _bytes(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(where).getLength()


def lookup(side: DataFrame, small: bool) -> DataFrame:
    """Hint a broadcast for a side whose measured size allows it; otherwise leave it to AQE."""
    return F.broadcast(side) if small else side


# Keys holding at least this share of the weight are looked up apart from the
# rest; there can be only `1 / HOT_SHARE` of them per unit of total weight.
HOT_SHARE = 1e-3


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str],
    small: bool,
    weight: str | None = None,
    total: int | None = None,
) -> DataFrame:
    """Left join to a table with unique keys (``on`` maps left to right columns).

    A small right side is broadcast.  A large one is shuffled, but its hot keys,
    few by arithmetic, are broadcast and the left rows that hit them are spread
    over all tasks instead of meeting in one.
    """
    payload = [c for c in right.columns if c not in on.values()]

    def joined(side: DataFrame, extra=()) -> DataFrame:
        named = side.select(
            *[F.col(r).alias(f"_key{i}") for i, r in enumerate(on.values())],
            *[c for c in side.columns if c not in on.values()],
        )
        named = F.broadcast(named) if "_salt" not in named.columns and (small or "_hot" in named.columns) else named
        tests = [F.col(name) == F.col(f"_key{i}") for i, name in enumerate(on)]
        tests += [out[c] == named[c] for c in extra]
        merged = out.join(named, reduce(lambda a, b: a & b, tests), "left")
        return merged.drop(*[f"_key{i}" for i in range(len(on))], *[named[c] for c in extra])

    out = left
    if small or weight is None or not total:
        return joined(right)
    hot = right.filter(F.col(weight) >= total * HOT_SHARE).select(
        *on.values(), *[F.col(c).alias(f"_hot_{c}") for c in payload], F.lit(True).alias("_hot")
    )
    out = joined(hot)
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(4096)).cast("int")
    out = out.withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(-1)))
    out = joined(right.withColumn("_salt", F.lit(-1)), ["_salt"])
    merged = {c: F.coalesce(F.col(f"_hot_{c}"), F.col(c)) for c in payload}
    return out.withColumns(merged).drop("_salt", "_hot", *[f"_hot_{c}" for c in payload])
