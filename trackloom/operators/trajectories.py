"""Rebuild long trajectories from windows and measure rollouts of given predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackloom import constants as K
from trackloom.operators import bounded

TRACK = ["dataset", "scene_id", "track_id"]
SEGMENT = [*TRACK, "segment"]
# One chunk of windows covers this many frames.
SPAN = 24576


def frame_period(dataset: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in K.FRAME_PERIOD.items() for v in kv])
    return known[dataset]


def split_segments(windows: DataFrame, keys: list[str] = TRACK, step: int = K.HISTORY) -> DataFrame:
    """Number the runs of windows whose ``frame_k`` advances by exactly ``step``.

    Adds ``segment`` and ``prev_frame_k``. Works on the narrow key columns; fat columns join back once.
    """
    keys = list(keys)
    chunk = bounded.frame_chunk("frame_k", SPAN)
    slim = windows.select(*keys, "frame_k")
    slim = bounded.previous_row(slim, keys, ["frame_k"], {"prev_frame_k": "frame_k"}, chunk)
    breaks = F.col("prev_frame_k").isNull() | (F.col("frame_k") - F.col("prev_frame_k") != step)
    return bounded.running_sums(slim, keys, ["frame_k"], {"segment": breaks.cast("long")}, chunk)


def segment_table(segments: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """One row per segment with window count and number of predicted steps."""
    out = segments.groupBy(*keys, "segment").agg(
        F.min("frame_k").alias("frame_k_start"), F.max("frame_k").alias("frame_k_end"),
        F.count(F.lit(1)).alias("windows"),
    )
    return out.withColumn("pred_steps", F.col("windows") * K.HISTORY - K.HISTORY + 1)


def tiling(windows: DataFrame, segments: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """Largest difference between the last next-state row of a window and the first row of the following one."""
    keys = list(keys)
    ends = windows.select(*keys, (F.col("frame_k") + K.HISTORY).alias("frame_k"), F.element_at("next_state", -1).alias("_end"))
    starts = windows.select(*keys, "frame_k", F.col("state")[0].alias("_start")).join(segments, [*keys, "frame_k"])
    follows = F.col("frame_k") - F.col("prev_frame_k") == K.HISTORY
    joined = starts.where(follows).join(ends, [*keys, "frame_k"])
    gap = F.array_max(F.zip_with("_end", "_start", lambda a, b: F.abs(a - b)))
    return joined.select(*keys, "segment", "frame_k", gap.cast("double").alias("tiling_diff"))


def reconstruct(windows: DataFrame, min_steps: int = 50, keys: list[str] = TRACK) -> DataFrame:
    """Rows of every long-enough segment: history rows are steps 0..11, predicted steps follow.

    Each row also carries the previous row's velocity and acceleration.
    """
    keys = list(keys)
    segments = split_segments(windows, keys)
    table = segment_table(segments, keys).where(F.col("pred_steps") >= min_steps)
    fat = windows.select(*keys, "frame_k", "state", F.element_at("next_state", -1).alias("_tail"))
    placed = fat.join(segments.join(table, [*keys, "segment"]), [*keys, "frame_k"])
    # The last row of the previous window, shifted onto the window it precedes.
    last = windows.select(*keys, (F.col("frame_k") + K.HISTORY).alias("frame_k"), F.element_at("state", -1).alias("_prev"))
    placed = placed.join(last, [*keys, "frame_k"], "left")
    base = F.col("frame_k") - F.col("frame_k_start")
    is_last = F.col("frame_k") == F.col("frame_k_end")
    rows = F.concat(F.col("state"), F.when(is_last, F.array("_tail")).otherwise(F.slice("state", 1, 0)))
    out = placed.withColumn("_prevs", F.concat(F.array("_prev"), F.col("state"))).select(
        *keys, "segment", "frame_k_start", "frame_k_end", "windows", "pred_steps", base.alias("_base"), "_prevs",
        F.posexplode(rows).alias("_j", "features"),
    )
    out = out.withColumn("step", F.col("_base") + F.col("_j")).withColumn("_p", F.col("_prevs")[F.col("_j")])

    def d(c: Column) -> Column:
        return c.cast("double")

    f, p = F.col("features"), F.col("_p")
    same = F.col("step") > 0
    return out.select(
        *keys, "segment", "frame_k_start", "frame_k_end", "windows", "pred_steps", "step", "features",
        d(f[0]).alias("vx"), d(f[1]).alias("ax"), d(f[2]).alias("vy"), d(f[3]).alias("ay"),
        *[F.when(same, d(p[i])).alias(f"prev_{n}") for i, n in enumerate(["vx", "ax", "vy", "ay"])],
    )


def rollout_steps(steps: DataFrame, predictions: DataFrame, mode: str = "semi", keys: list[str] = SEGMENT) -> DataFrame:
    """Integrate predicted accelerations along each segment and measure the running displacement error.

    ``predictions``: keys, step, model, ax_pred, ay_pred for steps >= history. ``semi`` carries the
    predicted velocity forward; ``teacher`` restarts from the true velocity at every step. Integration is a
    prefix sum, so no step waits for another.
    """
    if mode not in {"semi", "teacher"}:
        raise ValueError("mode must be 'semi' or 'teacher'")
    keys = list(keys)
    start = steps.where(F.col("step") == K.HISTORY - 1).select(*keys, F.col("vx").alias("_v0x"), F.col("vy").alias("_v0y"))
    rows = steps.where(F.col("step") >= K.HISTORY).drop("features").join(predictions, [*keys, "step"]).join(start, keys)
    rows = rows.withColumn("dt", frame_period(F.col("dataset"))).withColumn("_n", F.col("step") - K.HISTORY + 1)
    sums = {"_tvx": F.col("vx"), "_tvy": F.col("vy")}
    for axis in "xy":
        a = F.col(f"a{axis}_pred")
        if mode == "semi":
            sums |= {f"_a{axis}": a, f"_na{axis}": a * F.col("_n")}
        else:
            sums[f"_pv{axis}"] = F.col(f"prev_v{axis}") + a * F.col("dt")
    rows = bounded.running_sums(rows, [*keys, "model"], ["step"], sums, bounded.frame_chunk("step"))
    n, dt = F.col("_n"), F.col("dt")
    for axis in "xy":
        if mode == "semi":
            cum, weighted = F.col(f"_a{axis}"), F.col(f"_na{axis}")
            rows = rows.withColumn(f"v{axis}_pred", F.col(f"_v0{axis}") + cum * dt).withColumn(
                f"d{axis}_pred", (F.col(f"_v0{axis}") * n + ((n + 1) * cum - weighted) * dt) * dt
            )
        else:
            rows = rows.withColumn(f"v{axis}_pred", F.col(f"prev_v{axis}") + F.col(f"a{axis}_pred") * dt).withColumn(
                f"d{axis}_pred", F.col(f"_pv{axis}") * dt
            )
        rows = rows.withColumn(f"d{axis}_true", F.col(f"_tv{axis}") * dt)
    rows = rows.withColumn(
        "err", F.hypot(F.col("dx_pred") - F.col("dx_true"), F.col("dy_pred") - F.col("dy_true"))
    )
    return rows.drop("_v0x", "_v0y", "_n", *sums)


def va95(rows: DataFrame, group: list[str], vx: str, vy: str, ax: str, ay: str, name: str) -> DataFrame:
    product = (F.hypot(vx, vy) + 1e-9) * F.hypot(ax, ay)
    return bounded.quantile_columns(rows, group, product, {name: 0.95})


def rpa(vx: str, vy: str, ax: str, ay: str, dt: Column) -> Column:
    v, a = F.hypot(vx, vy), F.hypot(ax, ay)
    travelled = F.sum(v * dt)
    return F.when(travelled > 0, F.sum(v * F.greatest(a, F.lit(0.0)) * dt) / travelled)


def trajectory_metrics(rolled: DataFrame, relative: float = 0.05, absolute: float = 2.0,
                       keys: list[str] = SEGMENT) -> DataFrame:
    """One row per (segment, model): ADE, FDE, completion, VA95 and RPA."""
    keys = list(keys)
    group = [*keys, "model"]
    dt = F.col("dt")
    base = rolled.groupBy(*group).agg(
        F.first("frame_k_start").alias("frame_k_start"), F.first("frame_k_end").alias("frame_k_end"),
        F.first("windows").alias("windows"), F.count(F.lit(1)).alias("pred_steps"),
        F.avg("err").alias("ade"), F.max_by("err", "step").alias("fde"),
        F.max_by(F.hypot("dx_true", "dy_true"), "step").alias("true_path_len"),
        F.max_by(F.hypot("dx_pred", "dy_pred"), "step").alias("pred_path_len"),
        rpa("vx_pred", "vy_pred", "ax_pred", "ay_pred", dt).alias("rpa_pred"),
        rpa("vx", "vy", "ax", "ay", dt).alias("rpa_true"),
        F.sum(F.pow(F.col("ax_pred") - F.col("ax"), 2)).alias("sse_ax"),
        F.sum(F.pow(F.col("ay_pred") - F.col("ay"), 2)).alias("sse_ay"),
        F.sum(F.abs(F.col("ax_pred") - F.col("ax"))).alias("sae_ax"),
        F.sum(F.abs(F.col("ay_pred") - F.col("ay"))).alias("sae_ay"),
        F.max(F.greatest(*[F.abs(F.col(c)) for c in ("ax_pred", "ay_pred")])).alias("max_abs_pred"),
        F.max(F.greatest(*[F.abs(F.col(c)) for c in ("ax", "ay")])).alias("max_abs_true"),
    )
    base = base.withColumn("cr_threshold", F.greatest(F.lit(absolute), F.col("true_path_len") * relative))
    base = base.withColumn("complete", (F.col("fde") <= F.col("cr_threshold")).cast("long"))
    pred = va95(rolled, group, "vx_pred", "vy_pred", "ax_pred", "ay_pred", "va95_pred")
    true = va95(rolled, group, "vx", "vy", "ax", "ay", "va95_true")
    return base.join(pred, group, "left").join(true, group, "left")


def trajectory_summary(rows: DataFrame, group: list[str]) -> DataFrame:
    """Roll trajectories up to group level: means, quantiles, completion rate, RMSE of style metrics."""
    group = list(group)

    def rmse(a: str, b: str) -> Column:
        return F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), 2)))

    pair = lambda a, b: F.count(F.col(a) + F.col(b))
    base = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("trajectories"), F.sum("pred_steps").alias("pred_steps"),
        F.avg("ade").alias("ade_mean"), F.avg("fde").alias("fde_mean"), F.max("fde").alias("fde_max"),
        F.avg("complete").alias("cr_threshold_rate"),
        F.avg("true_path_len").alias("true_path_len_mean"), F.avg("pred_path_len").alias("pred_path_len_mean"),
        F.avg("pred_steps").alias("steps_per_traj_mean"),
        F.avg("va95_pred").alias("va95_pred_mean"), F.avg("va95_true").alias("va95_true_mean"),
        rmse("va95_pred", "va95_true").alias("va95_rmse"), pair("va95_pred", "va95_true").alias("va95_count"),
        F.avg("rpa_pred").alias("rpa_pred_mean"), F.avg("rpa_true").alias("rpa_true_mean"),
        rmse("rpa_pred", "rpa_true").alias("rpa_rmse"), pair("rpa_pred", "rpa_true").alias("rpa_count"),
        F.sqrt(F.sum("sse_ax") / F.sum("pred_steps")).alias("acc_rmse_x"),
        F.sqrt(F.sum("sse_ay") / F.sum("pred_steps")).alias("acc_rmse_y"),
        (F.sum("sae_ax") / F.sum("pred_steps")).alias("acc_mae_x"),
        (F.sum("sae_ay") / F.sum("pred_steps")).alias("acc_mae_y"),
    )
    qs = bounded.quantile_columns
    ade = qs(rows, group, F.col("ade"), {"ade_median": 0.5, "ade_p90": 0.9})
    fde = qs(rows, group, F.col("fde"), {"fde_median": 0.5, "fde_p90": 0.9, "fde_p95": 0.95, "fde_p99": 0.99})
    steps = qs(rows, group, F.col("pred_steps"), {"steps_per_traj_p90": 0.9})
    if not group:
        return base.crossJoin(ade).crossJoin(fde).crossJoin(steps)
    return base.join(ade, group).join(fde, group).join(steps, group)


def within_acceleration_limit(rows: DataFrame, limit: float = 10.0) -> DataFrame:
    """Drop trajectories whose predicted or true acceleration exceeds the limit anywhere."""
    return rows.where((F.col("max_abs_pred") <= limit) & (F.col("max_abs_true") <= limit))


def acceleration_series(rolled: DataFrame, limit: float = 10.0, keys: list[str] = SEGMENT) -> DataFrame:
    """True and predicted longitudinal series of segments that never exceed the limit, as ordered rows.

    Rows instead of one list per segment: a segment may be arbitrarily long.
    """
    bad = rolled.where(F.abs("ax") > limit).select(*keys).distinct()
    return rolled.join(bad, list(keys), "left_anti").select(*keys, "model", "step", "ax", "ax_pred")


def reconstruction_report(windows: DataFrame, min_steps: int = 50) -> DataFrame:
    """Overall diagnostics: segments, short segments, tiling differences, quantiles of steps."""
    segments = split_segments(windows)
    table = segment_table(segments)
    counts = table.agg(
        F.count(F.lit(1)).alias("segments_total"),
        F.count_if(F.col("pred_steps") < min_steps).alias("segments_short"),
        F.count_if(F.col("pred_steps") >= min_steps).alias("segments_selected"),
        F.max(F.when(F.col("pred_steps") >= min_steps, F.col("pred_steps"))).alias("pred_steps_max"),
    )
    kept = table.where(F.col("pred_steps") >= min_steps)
    diffs = tiling(windows, segments.join(kept.select(*TRACK, "segment"), [*TRACK, "segment"], "left_semi")).agg(
        F.count(F.lit(1)).alias("tiling_checks"),
        F.count_if(F.col("tiling_diff") > 1e-4).alias("tiling_bad"),
        F.coalesce(F.max("tiling_diff"), F.lit(0.0)).alias("tiling_max_diff"),
    )
    steps = bounded.quantile_columns(
        kept, [], F.col("pred_steps"), {"pred_steps_p50": 0.5, "pred_steps_p90": 0.9, "pred_steps_p99": 0.99}
    )
    return counts.crossJoin(diffs).crossJoin(steps)
