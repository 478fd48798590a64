"""Regression metrics of predictions against truth, all one-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

AXES = ("x", "y")


def join_predictions(windows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Align predictions (model, keys, frame_k, ax_pred, ay_pred) with the true action of each window."""
    keys = ["dataset", "scene_id", "track_id", "frame_k"]
    truth = windows.withColumn("ax_true", F.col("action")[0].cast("double")).withColumn(
        "ay_true", F.col("action")[1].cast("double")
    )
    return with_errors(truth.join(predictions, keys))


def with_errors(df: DataFrame) -> DataFrame:
    ex, ey = F.col("ax_pred") - F.col("ax_true"), F.col("ay_pred") - F.col("ay_true")
    return df.withColumn("err_x", F.abs(ex)).withColumn("err_y", F.abs(ey)).withColumn("err_norm", F.hypot(ex, ey))


def _sse(axis: str) -> Column:
    return F.sum(F.pow(F.col(f"a{axis}_pred") - F.col(f"a{axis}_true"), 2))


def r2_floor(ss_res: Column, ss_tot: Column) -> Column:
    return 1.0 - ss_res / F.greatest(ss_tot, F.lit(1e-12))


def r2_zero_var(ss_res: Column, ss_tot: Column) -> Column:
    return F.when(ss_tot > 0, 1.0 - ss_res / ss_tot).when(ss_res <= 0, 1.0).otherwise(0.0)


def r2_unit_denom(ss_res: Column, ss_tot: Column) -> Column:
    return 1.0 - ss_res / F.when(ss_tot > 0, ss_tot).otherwise(1.0)


def regression(df: DataFrame, group: list[str], rollup: bool = False) -> DataFrame:
    """RMSE, MAE, three R2 definitions and target deviation per axis and averaged."""
    grouped = df.rollup(*group) if rollup else df.groupBy(*group)
    n = F.count(F.lit(1))
    out = grouped.agg(
        n.alias("samples"),
        *[_sse(a).alias(f"_res_{a}") for a in AXES],
        *[(F.var_pop(f"a{a}_true") * n).alias(f"_tot_{a}") for a in AXES],
        *[F.avg(f"err_{a}").alias(f"mae_{a}") for a in AXES],
        *[F.stddev_pop(f"a{a}_true").alias(f"target_std_{a}") for a in AXES],
    )
    for a in AXES:
        res, tot = F.col(f"_res_{a}"), F.col(f"_tot_{a}")
        out = out.withColumns({
            f"rmse_{a}": F.sqrt(res / F.col("samples")),
            f"r2_floor_{a}": r2_floor(res, tot),
            f"r2_zero_var_{a}": r2_zero_var(res, tot),
            f"r2_unit_denom_{a}": r2_unit_denom(res, tot),
        })
    for m in ("rmse", "mae", "r2_floor", "r2_zero_var", "r2_unit_denom"):
        out = out.withColumn(f"{m}_mean", (F.col(f"{m}_x") + F.col(f"{m}_y")) / 2)
    return out.drop(*[f"_{k}_{a}" for k in ("res", "tot") for a in AXES])


def masked_rmse(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """RMSE over rows where both values are finite, and how many there were; null when none."""
    from trackloom.functions.columns import finite

    gap = F.when(finite(a) & finite(b), F.col(a) - F.col(b))
    return df.groupBy(*group).agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.count(gap).alias("n"))


def compare_methods(df: DataFrame, keys: list[str], models: list[str], value: str) -> DataFrame:
    """One row per key with a column per model, keeping only keys every model has."""
    wide = df.groupBy(*keys).pivot("model", models).agg(F.first(value))
    return wide.dropna(subset=models)


def to_long(wide: DataFrame, keys: list[str], columns: list[str], detail: list[str]) -> DataFrame:
    """Wide results to one row per (key, metric) with a JSON detail."""
    return wide.select(
        *keys, F.to_json(F.struct(*detail)).alias("detail"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_m"),
    ).select(*keys, "detail", "_m.metric", "_m.value")
