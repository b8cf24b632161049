"""Saving and loading fitted models as parquet tables plus one metadata row."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from likeness.operators.conditionals import ConditionalModel, read_roots
from likeness.plans.materialise import load_stored, store

_FORMAT = 1


def save_model(model: ConditionalModel, path: str) -> str:
    store(model.tokens.df, f"{path}/tokens")
    store(model.leaves.df, f"{path}/leaves")
    if model.edges is not None:
        store(model.edges.df, f"{path}/edges")
    meta = {
        "format": _FORMAT,
        "features": model.features,
        "kind": model.kind,
        "contexts": {str(k): v for k, v in model.contexts.items()},
        "root_split": {str(k): v for k, v in model.root_split.items()},
        "depth": model.depth,
        "edges": model.edges is not None,
    }
    spark = model.tokens.df.sparkSession
    # Written last, so a half-saved model has no metadata and does not load.
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/meta"
    )
    return path


def load_model(spark: SparkSession, path: str) -> ConditionalModel:
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    if meta["format"] != _FORMAT:
        raise ValueError(f"unknown model format {meta['format']}")
    leaves = load_stored(spark, f"{path}/leaves")
    return ConditionalModel(
        features=meta["features"],
        kind=meta["kind"],
        tokens=load_stored(spark, f"{path}/tokens"),
        leaves=leaves,
        roots=read_roots(leaves.df),
        contexts={int(k): v for k, v in meta["contexts"].items()},
        edges=load_stored(spark, f"{path}/edges") if meta["edges"] else None,
        root_split={int(k): v for k, v in meta["root_split"].items()},
        depth=meta["depth"],
    )
