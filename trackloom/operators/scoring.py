"""Predictors over windows: a plug-in for any batch function, and built-in baselines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

KEYS = ["dataset", "scene_id", "track_id", "frame_k"]


def score(windows: DataFrame, predict: Callable[[np.ndarray], np.ndarray], model: str, stats: dict | None = None) -> DataFrame:
    """Apply ``predict`` ([n,12,12] -> [n,2]) batch by batch.

    With ``stats`` (the norm_stats row as a dict) the function sees normalised input and its output is
    brought back to raw units.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            x = np.stack([np.stack(s) for s in b["state"]]).astype(np.float32)
            if stats:
                x = (x - np.asarray(stats["state_mean"], np.float32)) / np.asarray(stats["state_std"], np.float32)
            y = np.asarray(predict(x), dtype=float)
            if stats:
                y = y * np.asarray(stats["action_std"]) + np.asarray(stats["action_mean"])
            yield b[KEYS].assign(model=model, ax_pred=y[:, 0], ay_pred=y[:, 1])

    return windows.select(*KEYS, "state").mapInPandas(
        run,
        "dataset string, scene_id string, track_id string, frame_k bigint, model string, ax_pred double, ay_pred double",
    )


def persistence(windows: DataFrame, model: str = "persistence", gain: float = 1.0) -> DataFrame:
    """The last observed acceleration, optionally damped: the base a learned model adds its residual to."""
    last = F.element_at("state", -1)
    return windows.select(
        *KEYS, F.lit(model).alias("model"),
        (last[1].cast("double") * gain).alias("ax_pred"), (last[3].cast("double") * gain).alias("ay_pred"),
    )


def linear(train: DataFrame, windows: DataFrame, model: str = "linear") -> DataFrame:
    """Spark ML least squares on the last history row, one model per axis."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    def flat(df: DataFrame) -> DataFrame:
        last = F.element_at("state", -1)
        out = df.select(
            *KEYS, F.col("action")[0].cast("double").alias("_tx"), F.col("action")[1].cast("double").alias("_ty"),
            *[last[i].cast("double").alias(f"_f{i}") for i in range(12)],
        )
        return VectorAssembler(inputCols=[f"_f{i}" for i in range(12)], outputCol="_v").transform(out)

    fit, out = flat(train), flat(windows)
    for axis in "xy":
        lr = LinearRegression(featuresCol="_v", labelCol=f"_t{axis}", predictionCol=f"a{axis}_pred", regParam=1e-6)
        out = lr.fit(fit).transform(out)
    return out.select(*KEYS, F.lit(model).alias("model"), "ax_pred", "ay_pred")
