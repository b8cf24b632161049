"""Row scores on an unbounded table: the same stateless plan as the batch one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from likeness.operators.alignment import can_score_wide, upsilon_rows
from likeness.operators.conditionals import ConditionalModel


def score_stream(
    stream: DataFrame, model: ConditionalModel, keep: Sequence[str] = ("row_id",), epsilon: float = 0.0
) -> DataFrame:
    """(keep..., upsilon) for a streaming frame, by contexts or trees of any width; the model must be below the broadcast bound."""
    if not can_score_wide(model):
        raise ValueError("streams are scored with a model below the broadcast bound only")
    return upsilon_rows(stream, model, keep, epsilon)
