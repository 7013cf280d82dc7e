"""Row-local operators on streams: no state, no actions, so batch and stream share one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame

from ..functions.contractions import expand
from ..functions.text import strip_non_ascii, words
from ..operators.columns import col, time_slot

TEXT_STEPS: dict[str, Callable[[Column], Column]] = {"words": words, "strip_non_ascii": strip_non_ascii, "expand_contractions": expand}


def text_stream(stream: DataFrame, text: str, steps: dict[str, str]) -> DataFrame:
    """Adds a column per step: new name -> name in TEXT_STEPS."""
    for to, step in steps.items():
        stream = stream.withColumn(to, TEXT_STEPS[step](col(text)))
    return stream


def slot_stream(stream: DataFrame, ts: str, interval: str, to: str = "slot") -> DataFrame:
    return stream.withColumn(to, time_slot(col(ts), interval))


def score_stream(stream: DataFrame, model: Model) -> DataFrame:
    """A model fitted on a batch (gibberish, rare categories, selectors, scalers) applied to a stream."""
    return model.transform(stream)
