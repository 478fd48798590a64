"""Time-to-collision distributions and their errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trackloom.functions import columns as C
from trackloom.operators import bounded

BINS = 100
TOP = 5.0
MIN_VALUES = 20
QUANTILE_GRID = [0.01 + 0.98 * i / 159 for i in range(160)]


def window_values(df: DataFrame, horizon: float) -> DataFrame:
    """Adds ``ttc_pred`` and ``ttc_true`` from the last history row; null where not valid."""
    last = F.element_at("state", -1)
    speed = F.hypot(last[0].cast("double"), last[2].cast("double"))
    front = last[4].cast("double")
    return df.withColumn("ttc_pred", C.window_ttc(front, speed, F.col("ax_pred"), horizon)).withColumn(
        "ttc_true", C.window_ttc(front, speed, F.col("ax_true"), horizon)
    )


def value_bin(value: Column) -> Column:
    return F.when(value.isNotNull(), F.least(F.lit(BINS - 1), F.floor(value * (BINS / TOP)))).cast("int")


def peaks_from_counts(counts: DataFrame, group: list[str]) -> DataFrame:
    """Centre of the first highest bin of the 5-tap smoothed histogram; ``counts``: group, bin, n."""
    keys = counts.groupBy(*group).agg(F.sum("n").alias("n_values"))
    grid = keys.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    full = grid.join(counts, [*group, "bin"], "left").na.fill(0, ["n"])
    # At most 100 rows per group here.
    smooth = F.sum("n").over(W.partitionBy(*group).orderBy("bin").rowsBetween(-2, 2))
    best = full.withColumn("_s", smooth).groupBy(*group).agg(
        F.max(F.struct("_s", (-F.col("bin")).alias("_b"))).alias("_m"), F.max("n_values").alias("n_values")
    )
    centre = (-F.col("_m._b") + 0.5) * (TOP / BINS)
    return best.select(*group, "n_values", F.when(F.col("n_values") >= MIN_VALUES, centre).alias("peak"))


def histogram(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*group, value_bin(F.col(value)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def peak_error(df: DataFrame, group: list[str]) -> DataFrame:
    pred = peaks_from_counts(histogram(df, group, "ttc_pred"), group)
    true = peaks_from_counts(histogram(df, group, "ttc_true"), group)
    return pred.select(*group, F.col("n_values").alias("n_pred"), F.col("peak").alias("peak_pred")).join(
        true.select(*group, F.col("n_values").alias("n_true"), F.col("peak").alias("peak_true")), group
    ).withColumn("peak_error", F.abs(F.col("peak_pred") - F.col("peak_true")))


def quantile_error(df: DataFrame, group: list[str]) -> DataFrame:
    """RMS difference of 160 quantiles; null when either side has fewer than 20 values."""
    pred = bounded.quantiles(df, group, F.col("ttc_pred"), QUANTILE_GRID, "_p")
    true = bounded.quantiles(df, group, F.col("ttc_true"), QUANTILE_GRID, "_t")
    sq = F.aggregate(F.zip_with("_p", "_t", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    n = F.least("_p_n", "_t_n")
    return pred.join(true, group).select(
        *group, n.alias("n_ttc"), F.when(n >= MIN_VALUES, F.sqrt(sq / len(QUANTILE_GRID))).alias("quantile_error")
    )


def combined_error(peak: Column, quantile: Column) -> Column:
    """Peak error, else quantile error; a zero peak gets a one-bin floor; plus a small quantile term."""
    base = F.when(peak.isNull(), quantile).when(
        (peak == 0) & (quantile > 0), F.greatest(quantile, F.lit(TOP / BINS))
    ).otherwise(peak)
    return base + F.coalesce(F.least(quantile, F.lit(0.02)), F.lit(0.0))


def error_report(df: DataFrame, group: list[str]) -> DataFrame:
    """Peak, quantile and combined errors per group."""
    out = peak_error(df, group).join(quantile_error(df, group), group)
    return out.withColumn("ttc_error", combined_error(F.col("peak_error"), F.col("quantile_error")))


def series_summary(df: DataFrame, group: list[str], value: str = "ttc") -> DataFrame:
    """Minimum, mean and quantiles of the finite values; infinite when there are none."""
    inf = F.lit(float("inf"))
    v = F.when(C.finite(value), F.col(value))
    base = df.where(F.col(value).isNotNull()).groupBy(*group).agg(
        F.min(v).alias("ttc_min"), F.avg(v).alias("ttc_mean"),
        (F.count(v) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("ttc_finite_ratio"),
    )
    qs = bounded.quantile_columns(df, group, v, {"ttc_p05": 0.05, "ttc_median": 0.5, "ttc_p95": 0.95})
    out = base.join(qs, group, "left") if group else base.join(qs, F.lit(True), "left")
    names = ["ttc_min", "ttc_mean", "ttc_median", "ttc_p05", "ttc_p95"]
    return out.select(*group, *[F.coalesce(n, inf).alias(n) for n in names], "ttc_finite_ratio")
