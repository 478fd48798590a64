"""Ranking of unusual tracks and per-case comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackloom import constants as K
from trackloom.operators import bounded
from trackloom.operators.trajectories import frame_period

TRACK = ["dataset", "scene_id", "recording", "track_id"]


def robust_z(df: DataFrame, columns: list[str], clip: float = 4.0) -> DataFrame:
    """(x - median) / IQR per column over the whole table, as ``z_<column>``.

    Missing values count as the median; a vanishing IQR falls back to the deviation, then to 1.
    """
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns
    ])))
    long = long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    middle = bounded.quantile_columns(long, ["name"], F.col("value"), {"_fill": 0.5})
    filled = long.join(middle, "name").withColumn("value", F.coalesce("value", "_fill"))
    spread = bounded.quantile_columns(filled, ["name"], F.col("value"), {"_med": 0.5, "_q1": 0.25, "_q3": 0.75})
    moments = filled.groupBy("name").agg(F.stddev_pop("value").alias("_sd"), F.first("_fill").alias("_fill"))
    iqr = F.col("_q3") - F.col("_q1")
    scale = F.when(iqr >= 1e-9, iqr).when(F.col("_sd") >= 1e-9, F.col("_sd")).otherwise(1.0)
    one = spread.join(moments, "name").select("name", F.struct("_fill", "_med", scale.alias("_scale")).alias("_s"))
    one = one.agg(F.map_from_entries(F.collect_list(F.struct("name", "_s"))).alias("_z"))
    df = df.join(F.broadcast(one), F.lit(True), "left")  # one row holding a few numbers per column
    for c in columns:
        s = F.col("_z")[c]
        x = F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), s["_fill"])
        z = F.greatest(F.lit(-clip), F.least(F.lit(clip), (x - s["_med"]) / s["_scale"]))
        df = df.withColumn(f"z_{c}", F.coalesce(z, F.lit(0.0)))
    return df.drop("_z")


def wrapped(angle: Column) -> Column:
    """Angle difference folded into (-pi, pi]."""
    two_pi = 2 * 3.141592653589793
    return angle - F.ceil((angle - 3.141592653589793) / two_pi) * two_pi


def track_shape(rows: DataFrame, history: int = K.HISTORY, keys: list[str] = TRACK) -> DataFrame:
    """One row per track: heading change, acceleration p95, path length, displacement, lateral deviation.

    Displacement and deviation are measured from the last history row on, against the chord to the last row.
    """
    keys = list(keys)
    prev = bounded.previous_row(rows, keys, ["frame"], {"_px": "x", "_py": "y", "_ph": "heading"})
    placed = bounded.positions(prev, keys, ["frame"], name="_pos")
    steps = placed.withColumn("_turn", wrapped(F.col("heading") - F.col("_ph"))).withColumn(
        "_len", F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py"))
    )
    point = F.struct("x", "y")
    future = F.col("_pos") >= history
    base = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.abs(F.sum("_turn")).alias("heading_change_rad"),
        F.coalesce(F.sum("_len"), F.lit(0.0)).alias("path_len"),
        F.max(F.when(F.col("_pos") == history - 1, point)).alias("_anchor"),
        F.max_by(F.when(future, point), "_pos").alias("_end"),
    )
    acc = bounded.quantile_columns(rows, keys, F.hypot("ax", "ay"), {"acc_p95": 0.95})
    cx, cy = F.col("_end.x") - F.col("_anchor.x"), F.col("_end.y") - F.col("_anchor.y")
    base = base.withColumn("_cx", cx).withColumn("_cy", cy).withColumn("_chord", F.hypot("_cx", "_cy"))
    rel = placed.where(future).join(base.select(*keys, "_anchor", "_cx", "_cy", "_chord"), keys)
    cross = F.abs((F.col("x") - F.col("_anchor.x")) * F.col("_cy") - (F.col("y") - F.col("_anchor.y")) * F.col("_cx"))
    side = rel.groupBy(*keys).agg(
        F.max(F.when(F.col("_chord") > 1e-6, cross / F.col("_chord")).otherwise(0.0)).alias("max_lateral_deviation")
    )
    out = base.join(acc, keys).join(side, keys, "left")
    return out.select(
        *keys, "n_frames", "heading_change_rad", "acc_p95", "path_len",
        F.coalesce("_chord", F.lit(0.0)).alias("net_displacement"),
        F.coalesce("max_lateral_deviation", F.lit(0.0)).alias("max_lateral_deviation"),
        ((F.col("n_frames") - 1) * frame_period(F.col("dataset"))).alias("duration_sec"),
    )


def scored(shapes: DataFrame) -> DataFrame:
    """Weighted sum of robust z-scores."""
    df = shapes.withColumn("curvature_ratio", F.col("path_len") / F.greatest(F.col("net_displacement"), F.lit(1e-6)))
    df = robust_z(df, list(K.LONGTAIL_WEIGHTS))
    score = sum((F.col(f"z_{c}") * w for c, w in K.LONGTAIL_WEIGHTS.items()), F.lit(0.0))
    return df.withColumn("longtail_score", score)


def preselect(scores: DataFrame, per_dataset: int = 8, overall: int = 12, min_turn: float = 0.08) -> DataFrame:
    """Per dataset the best turning tracks (or the best of all if none turns), then the best overall."""
    turning = scores.where(F.col("heading_change_rad") > min_turn)
    without = scores.join(turning.select("dataset").distinct(), "dataset", "left_anti")
    order = [F.desc("longtail_score"), F.asc("scene_id"), F.asc("track_id")]
    picked = bounded.top_per_group(turning.unionByName(without), ["dataset"], order, per_dataset)
    return picked.orderBy(*order, "dataset").limit(overall)


def case_dynamics(series: DataFrame, truth: str = "GT") -> DataFrame:
    """Absolute error of every method against the truth, frame rank by frame rank, as far as both go.

    ``series``: case_id, method, frame, speed, accel.
    """
    placed = bounded.positions(series, ["case_id", "method"], ["frame"], name="rank")
    gt = placed.where(F.col("method") == truth).select(
        "case_id", "rank", F.col("speed").alias("speed_true"), F.col("accel").alias("accel_true")
    )
    return placed.where(F.col("method") != truth).join(gt, ["case_id", "rank"]).select(
        "case_id", "method", "rank",
        F.abs(F.col("speed") - F.col("speed_true")).alias("speed_error"),
        F.abs(F.col("accel") - F.col("accel_true")).alias("accel_error"),
    )


def positions_in_segments(positions_: DataFrame, segments: DataFrame, keys: list[str], span: int = 120) -> DataFrame:
    """Positions of a track within its segments: an interval join on the track and a stretch of ``span`` frames, so that a row
    meets the segments of its own stretch and not all of its track. One frame behind a segment's last window belongs to it.

    ``positions_``: keys, frame, x, y. ``segments``: keys, segment, frame_k_start, frame_k_end. Step 11 is the first frame.
    """
    keys = list(keys)
    part = lambda c: F.floor(c / span)
    last = F.col("frame_k_end") + 1
    parts = segments.select(*keys, "segment", "frame_k_start", last.alias("_last"), F.explode(F.sequence(part(F.col("frame_k_start")), part(last))).alias("_part"))
    rows = positions_.select(*keys, "frame", "x", "y", part(F.col("frame")).alias("_part"))
    inside = rows.join(parts, [*keys, "_part"]).where(F.col("frame").between(F.col("frame_k_start"), F.col("_last")))
    return inside.select(*keys, "segment", (F.col("frame") - F.col("frame_k_start") + K.HISTORY - 1).alias("step"), "x", "y")


def rollout_against_positions(rolled: DataFrame, positions_: DataFrame, keys: list[str]) -> DataFrame:
    """ADE, FDE, largest error and path lengths of a rollout measured against recorded positions.

    ``positions_``: keys, step, x, y with the anchor at the last history step.
    """
    keys = list(keys)
    anchor = positions_.where(F.col("step") == K.HISTORY - 1).select(*keys, F.col("x").alias("_ax"), F.col("y").alias("_ay"))
    rows = rolled.join(positions_.select(*keys, "step", "x", "y"), [*keys, "step"]).join(anchor, keys)
    rows = rows.withColumn("_px", F.col("_ax") + F.col("dx_pred")).withColumn("_py", F.col("_ay") + F.col("dy_pred"))
    rows = rows.withColumn("_e", F.hypot(F.col("_px") - F.col("x"), F.col("_py") - F.col("y")))
    group = [*keys, "model"]
    rows = bounded.previous_row(
        rows, group, ["step"], {"_qx": "_px", "_qy": "_py", "_tx": "x", "_ty": "y"}, bounded.frame_chunk("step")
    )
    out = rows.groupBy(*group).agg(
        F.avg("_e").alias("ade_m"), F.max_by("_e", "step").alias("fde_m"), F.max("_e").alias("max_error_m"),
        F.coalesce(F.sum(F.hypot(F.col("_px") - F.col("_qx"), F.col("_py") - F.col("_qy"))), F.lit(0.0)).alias("pred_path_len_m"),
        F.coalesce(F.sum(F.hypot(F.col("x") - F.col("_tx"), F.col("y") - F.col("_ty"))), F.lit(0.0)).alias("true_path_len_m"),
    )
    return out.withColumn("path_ratio", F.col("pred_path_len_m") / F.greatest("true_path_len_m", F.lit(1e-9)))
