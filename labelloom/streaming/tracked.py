"""Tracked values of training as a stream: averages and bests go on where the run before stopped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What is kept of a key between batches and between runs: whole numbers and doubles, no history.
STATE = "steps long, ema double, best double"
OUT = "name string, step long, value double, steps long, ema double, best double, is_best boolean"


def tracked(rows: DataFrame, key: str = "name", order: str = "step", value: str = "value", alpha: float = 0.95, largest: bool = True) -> DataFrame:
    """A stream of values with each one's moving average and best up to itself, by key: name, step, value, steps, ema, best, is_best.

    Values of a batch are taken in the order of step, batches as they come; so the result equals track.moving_average() and
    track.best_so_far() over all rows if steps come in order, whatever pieces they come in. NULL and NaN values are handed on and change nothing.
    State is a row of three numbers a key, kept in the query's checkpoint.
    """

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, ema, best = state.get if state.exists else (0, 0.0, float("-inf") if largest else float("inf"))
        batch = pd.concat(list(frames)).sort_values(["step", "value"], kind="stable")
        out = []
        for step, v in zip(batch["step"], batch["value"], strict=True):
            if pd.isna(v):
                out.append((keys[0], step, None, steps, ema if steps else None, best if steps else None, False))
                continue
            steps, ema = steps + 1, ema * alpha + v * (1 - alpha) if steps else v
            best = max(best, v) if largest else min(best, v)
            out.append((keys[0], step, v, steps, ema, best, v == best))
        state.update((steps, float(ema), float(best)))
        yield pd.DataFrame(out, columns=["name", "step", "value", "steps", "ema", "best", "is_best"]).astype({"step": "int64", "steps": "int64", "value": "float64", "ema": "float64", "best": "float64"})

    plain = rows.select(F.col(key).cast("string").alias("name"), F.col(order).cast("long").alias("step"), F.col(value).cast("double").alias("value"))
    return plain.groupBy("name").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
