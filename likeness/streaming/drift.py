"""Drift of the alignment by event-time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.operators.alignment import can_score_wide, wide_values
from likeness.operators.conditionals import ConditionalModel


def drift(
    records: DataFrame,
    model: ConditionalModel,
    time_col: str,
    window: str = "1 day",
    late: str = "1 day",
    by: Sequence[str] = (),
    epsilon: float = 0.0,
) -> DataFrame:
    """(by..., start, end, n_rows, cells, upsilon_mean) for each tumbling window of event time.

    The same plan on a table and on a stream: each record is scored where it is, and a
    window keeps one sum and two counts, added up map-side, so a busy window is no hot group.  On a stream
    rows later than ``late`` behind the latest time seen are left out and a window is emitted (append mode)
    once the watermark passes its end.  Records without a time have no window.  ``time_col``
    may be a timestamp with or without time zone.
    """
    if not can_score_wide(model):
        raise ValueError("drift is watched with a model below the broadcast bound only")
    stamped = records.withColumn("_ts", F.col(time_col).cast("timestamp")).filter("_ts is not null")
    if records.isStreaming:
        stamped = stamped.withWatermark("_ts", late)
    scored = wide_values(stamped, model, ["_ts", *by], epsilon)
    values = [F.col(f"v{i}") for i in range(len(model.features))]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    cells = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    windows = scored.select(*by, F.window("_ts", window).alias("_w"), total.alias("_v"), cells.cast("bigint").alias("_c"))
    summed = windows.groupBy(*by, "_w").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_c").alias("cells"), F.sum("_v").alias("_v"))
    return summed.select(
        *by, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n_rows", "cells",
        F.try_divide(F.col("_v"), F.col("cells")).alias("upsilon_mean"),
    )
