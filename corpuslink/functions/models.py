"""Where models are plugged in: text to text, in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType


def map_model(rows: DataFrame, prompt: str, model: Callable[[list[str]], list[str | None]], batch: int = 16, name: str = "answer") -> DataFrame:
    """The rows with the model's answer to their prompt. A call that fails, or returns another number of answers, gives nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list = []
            for k in range(0, len(frame), batch):
                part = frame[prompt].iloc[k : k + batch].tolist()
                try:
                    said = list(model(part))
                except Exception:  # a model is foreign code; its failures are data
                    said = []
                out += said if len(said) == len(part) else [None] * len(part)
            yield frame.assign(**{name: pd.Series(out, index=frame.index, dtype=object)})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(name, StringType())]))
