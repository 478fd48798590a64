"""Metrics over every quantile slice of the data.

Slice bounds are inclusive quantiles of a feature within a scope (everything, or one dataset). Every slice
is reported; none is chosen by its outcome. Additive metrics come from one pass: the bounds of a
(scope, feature) cut its value axis into elementary buckets, rows are summed per bucket before the
shuffle, and a slice is a run of buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trackloom import constants as K
from trackloom.operators import bounded, metrics, ttc

KEYS = ["dataset", "scene_id", "track_id", "frame_k"]
NEAR = slice(4, 12)

FEATURES = [
    "speed", "prev_acc", "prev_ax_abs", "prev_ay_abs", "target_ax", "target_ax_abs", "target_ay_abs", "target_acc",
    "front_dist", "min_neighbor", "min_frontback",
]


def with_slice_features(df: DataFrame) -> DataFrame:
    """Features of the last history row and of the target.

    ``min_neighbor`` clips the missing-sector sentinel to 0, as published; ``nearest_gap`` ignores
    missing sectors instead.
    """
    last = F.element_at("state", -1)
    f = [last[i].cast("double") for i in range(12)]
    tx, ty = F.col("action")[0].cast("double"), F.col("action")[1].cast("double")
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(200.0), c))
    return df.withColumns({
        "speed": F.hypot(f[0], f[2]),
        "prev_acc": F.hypot(f[1], f[3]),
        "prev_ax_abs": F.abs(f[1]),
        "prev_ay_abs": F.abs(f[3]),
        "target_ax": tx,
        "target_ax_abs": F.abs(tx),
        "target_ay_abs": F.abs(ty),
        "target_acc": F.hypot(tx, ty),
        "front_dist": F.when(f[4] > 0, f[4]),
        "min_neighbor": F.least(*[clip(c) for c in f[NEAR]]),
        "min_frontback": F.least(clip(f[4]), clip(f[5])),
        "nearest_gap": F.least(*[F.when(c >= 0, c) for c in f[NEAR]]),
    })


def _long(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in features])
    return df.select(
        *keep, F.explode(F.array(F.lit("all"), F.col("dataset"))).alias("scope"), pairs.alias("_p")
    ).select(*keep, "scope", F.explode("_p").alias("_f")).select(*keep, "scope", "_f.feature", "_f.value").where(
        F.col("value").isNotNull()
    )


def _bounds(df: DataFrame, features: list[str], ranges: list[tuple[float, float]], min_population: int) -> DataFrame:
    probs = sorted({p for r in ranges for p in r})
    qs = bounded.quantiles(_long(df, features, []), ["scope", "feature"], F.col("value"), probs, "_qs")
    qs = qs.where(F.col("_qs_n") >= min_population)
    spec = F.array(*[
        F.struct(
            F.lit(lo).alias("q_lo"), F.lit(hi).alias("q_hi"),
            F.col("_qs")[probs.index(lo)].alias("value_lo"), F.col("_qs")[probs.index(hi)].alias("value_hi"),
        )
        for lo, hi in ranges
    ])
    return qs.select(
        "scope", "feature", F.col("_qs_n").alias("population"),
        F.array_sort(F.array_distinct("_qs")).alias("edges"), spec.alias("ranges"),
    )


def slice_table(df: DataFrame, features: list[str], ranges: list[tuple[float, float]], min_population: int = 20) -> DataFrame:
    """scope, feature, q_lo, q_hi and the value bounds of every slice with enough population."""
    b = _bounds(df, features, ranges, min_population)
    return b.select("scope", "feature", "population", F.explode("ranges").alias("_r")).select(
        "scope", "feature", "population", "_r.*"
    )


def _code(value: Column, edges: Column) -> Column:
    """Odd codes are the edges themselves, even codes the gaps between them."""
    below = F.size(F.filter(edges, lambda e: e < value))
    return below * 2 + F.when(F.array_contains(edges, value), 1).otherwise(0)


def _bucket_rows(df: DataFrame, features: list[str], bounds: DataFrame, keep: list[str]) -> DataFrame:
    long = _long(df, features, keep).join(bounds.select("scope", "feature", "edges"), ["scope", "feature"])
    return long.withColumn("code", _code(F.col("value"), F.col("edges"))).drop("edges", "value")


def _over_slices(buckets: DataFrame, bounds: DataFrame, aggs: list[Column], extra: list[str] = ()) -> DataFrame:
    slices = bounds.select("scope", "feature", "edges", F.explode("ranges").alias("_r")).select(
        "scope", "feature", "_r.*",
        _code(F.col("_r.value_lo"), F.col("edges")).alias("_c0"), _code(F.col("_r.value_hi"), F.col("edges")).alias("_c1"),
    )
    inside = buckets.join(slices, ["scope", "feature"]).where(F.col("code").between(F.col("_c0"), F.col("_c1")))
    return inside.groupBy("scope", "feature", "q_lo", "q_hi", "value_lo", "value_hi", *extra).agg(*aggs)


def slice_metrics(wide: DataFrame, models: list[str], features: list[str], ranges: list[tuple[float, float]],
                  min_population: int = 20, min_samples: int = 1) -> DataFrame:
    """Samples, RMSE and R2 of every model on every slice.

    ``wide`` has one row per window: slice features, ``ax_true``, ``ay_true`` and ``ax_<model>``,
    ``ay_<model>`` columns. ``fingerprint`` identifies the set of rows of a slice.
    """
    bounds = _bounds(wide, features, ranges, min_population)
    value_cols = ["ax_true", "ay_true", *[f"a{a}_{m}" for m in models for a in "xy"]]
    rows = _bucket_rows(wide.withColumn("_h", F.xxhash64(*KEYS)), features, bounds, ["_h", *value_cols])
    sums = {"n": F.count(F.lit(1)), "_fp": F.bit_xor("_h")}
    for a in "xy":
        t = F.col(f"a{a}_true")
        # Centred squares: the difference of two large sums would lose the digits of a small spread.
        sums |= {f"_s_{a}": F.sum(t), f"_q_{a}": F.var_pop(t) * F.count(t)}
        for m in models:
            sums[f"_e_{a}_{m}"] = F.sum(F.pow(F.col(f"a{a}_{m}") - t, 2))
    buckets = rows.groupBy("scope", "feature", "code").agg(*[v.alias(k) for k, v in sums.items()])
    again = [F.bit_xor("_fp").alias("fingerprint") if k == "_fp" else F.sum(k).alias(k) for k in sums]
    # Between the buckets: each bucket's mean, once for each of its rows.
    again += [(F.sum(F.pow(F.col(f"_s_{a}"), 2) / F.col("n")) - F.pow(F.sum(f"_s_{a}"), 2) / F.sum("n")).alias(f"_between_{a}") for a in "xy"]
    out = _over_slices(buckets, bounds, again).where(F.col("n") >= min_samples)
    n = F.col("n")
    per_model = []
    for m in models:
        fields = [F.lit(m).alias("model")]
        r2 = []
        for a in "xy":
            res = F.col(f"_e_{a}_{m}")
            tot = F.greatest(F.col(f"_q_{a}") + F.col(f"_between_{a}"), F.lit(0.0))
            fields.append(F.sqrt(res / n).alias(f"rmse_{a}"))
            r2.append(metrics.r2_unit_denom(res, tot))
        fields += [r2[0].alias("r2_x"), r2[1].alias("r2_y"), ((r2[0] + r2[1]) / 2).alias("r2_mean")]
        per_model.append(F.struct(*fields))
    keep = ["scope", "feature", "q_lo", "q_hi", "value_lo", "value_hi", "fingerprint", n.cast("long").alias("samples")]
    return out.select(*keep, F.explode(F.array(*per_model)).alias("_m")).select(
        "scope", "feature", "q_lo", "q_hi", "value_lo", "value_hi", "samples", "fingerprint", "_m.*"
    )


def slice_ttc_peaks(wide: DataFrame, models: list[str], features: list[str], ranges: list[tuple[float, float]],
                    horizons: list[float], min_population: int = 20) -> DataFrame:
    """TTC peak error of every model on every slice and horizon, from additive histograms."""
    bounds = _bounds(wide, features, ranges, min_population)
    last = F.element_at("state", -1)
    front, speed = last[4].cast("double"), F.hypot(last[0].cast("double"), last[2].cast("double"))
    from trackloom.functions.columns import window_ttc

    series = F.array(*[
        F.struct(
            F.lit(name).alias("model"), F.lit(float(h)).alias("horizon"),
            ttc.value_bin(window_ttc(front, speed, F.col(f"ax_{name}"), h)).alias("bin"),
        )
        for name in ["true", *models] for h in horizons
    ])
    rows = _bucket_rows(wide.withColumn("_series", F.filter(series, lambda s: s["bin"].isNotNull())), features, bounds, ["_series"])
    rows = rows.select("scope", "feature", "code", F.explode("_series").alias("_v")).select(
        "scope", "feature", "code", "_v.*"
    )
    buckets = rows.groupBy("scope", "feature", "code", "model", "horizon", "bin").agg(F.count(F.lit(1)).alias("n"))
    counts = _over_slices(buckets, bounds, [F.sum("n").alias("n")], ["model", "horizon", "bin"])
    name = ["scope", "feature", "q_lo", "q_hi", "horizon"]
    counts = counts.drop("value_lo", "value_hi")
    peaks = ttc.peaks_from_counts(counts, [*name, "model"])
    truth = peaks.where(F.col("model") == "true").select(*name, F.col("peak").alias("peak_true"))
    return peaks.where(F.col("model") != "true").join(truth, name).select(
        *name, "model", F.col("n_values").alias("n_ttc"), F.abs(F.col("peak") - F.col("peak_true")).alias("peak_error")
    )


def error_order_flag(models: list[str]) -> Column:
    """True where the longitudinal errors of the models are non-decreasing in the given order."""
    err = lambda m: F.abs(F.col(f"ax_{m}") - F.col("ax_true"))
    return reduce(lambda a, b: a & b, [err(x) <= err(y) for x, y in zip(models[:-1], models[1:])], F.lit(True))


def ordered_slices(wide: DataFrame, models: list[str], ranges: list[tuple[float, float]], min_population: int = 20) -> DataFrame:
    """Outcome-conditioned slices: rows whose errors are already in order, and quantiles of the first model's
    error inside. Labelled as such; never a headline number."""
    rows = wide.where(error_order_flag(models)).withColumn("ordered_err_x", F.abs(F.col(f"ax_{models[0]}") - F.col("ax_true")))
    out = slice_metrics(rows, models, ["ordered_err_x"], ranges, min_population)
    return out.where(F.col("scope") == "all").withColumn("kind", F.lit("outcome_conditioned"))


def error_ranks(df: DataFrame, group: list[str], error: str, keys: list[str] = KEYS) -> DataFrame:
    """Rank of the error in [0, 1] per group; ties by key. Ranking runs inside value buckets."""
    placed = bounded.positions(df, group, [error, *keys], bounded._bucket(F.col(error)), "_r")
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(n, group).withColumn(
        "error_rank", F.col("_r") / F.greatest(F.col("_n") - 1, F.lit(1))
    ).drop("_r", "_n")


def stratified_mixes(ranked: DataFrame, group: list[str], good=K.GOOD_RANK_RANGES, tail=K.TAIL_RANK_RANGES) -> DataFrame:
    """Metrics of every union of a low-error band and a tail band.

    Bands overlap, so rows are first summed per elementary rank bucket.
    """
    edges = sorted({e for r in [*good, *tail] for e in r})
    edge_col = F.array(*[F.lit(float(e)) for e in edges])
    sums = {"n": F.count(F.lit(1)), "sse_x": F.sum(F.pow("err_x", 2)), "sse_y": F.sum(F.pow("err_y", 2))}
    buckets = ranked.withColumn("code", _code(F.col("error_rank"), edge_col)).groupBy(*group, "code").agg(
        *[v.alias(k) for k, v in sums.items()]
    )
    code = {e: 2 * i + 1 for i, e in enumerate(edges)}
    mixes = F.array(*[
        F.struct(
            F.lit(float(g[1])).alias("good_hi"), F.lit(float(t[0])).alias("tail_lo"), F.lit(float(t[1])).alias("tail_hi"),
            F.col("code").between(code[g[0]], code[g[1]]).alias("in_good"),
            F.col("code").between(code[t[0]], code[t[1]]).alias("in_tail"),
        )
        for g in good for t in tail
    ])
    rows = buckets.withColumn("_m", F.explode(mixes)).where(F.col("_m.in_good") | F.col("_m.in_tail"))
    out = rows.groupBy(*group, "_m.good_hi", "_m.tail_lo", "_m.tail_hi").agg(*[F.sum(k).alias(k) for k in sums])
    n = F.col("n")
    return out.select(
        *group, "good_hi", "tail_lo", "tail_hi", n.cast("long").alias("samples"),
        F.sqrt(F.col("sse_x") / n).alias("rmse_x"), F.sqrt(F.col("sse_y") / n).alias("rmse_y"),
    )


def screen(metrics_table: DataFrame, r2_interval: tuple[float, float], margin: float = 0.006, cap: int | None = None) -> DataFrame:
    """Cheap screen: slices whose R2 lies within a caller-supplied interval, best first, identical row sets once.

    ``cap`` keeps that many slices per model, best first; without it all that pass are kept.
    """
    from pyspark.sql import Window as W
    from trackloom.functions.columns import in_interval, interval_distance

    lo, hi = r2_interval
    score = interval_distance(F.col("r2_mean"), lo, hi, max((hi - lo) * 0.5, 1e-6))
    passed = metrics_table.where(in_interval(F.col("r2_mean"), lo - margin, hi + margin)).withColumn("screen_score", score)
    name = ["scope", "feature", "q_lo", "q_hi"]
    rest = [c for c in passed.columns if c not in {"model", "fingerprint", "samples"}]
    once = passed.groupBy("model", "fingerprint", "samples").agg(
        F.min_by(F.struct(*rest), F.struct("screen_score", *name)).alias("_s")
    ).select("model", "fingerprint", "samples", *[F.col("_s")[c].alias(c) for c in rest])
    w = W.partitionBy("model").orderBy("screen_score", F.desc("samples"), *name)
    ranked_ = once.withColumn("screen_rank", F.row_number().over(w))
    return ranked_ if cap is None else ranked_.where(F.col("screen_rank") <= cap)


def ranked(table: DataFrame, metric: str, within: list[str], descending: bool = False) -> DataFrame:
    """Rank every slice by a caller-chosen metric; also says how many slices were tried."""
    from pyspark.sql import Window as W

    name = ["scope", "feature", "q_lo", "q_hi"]
    key = F.desc(metric) if descending else F.asc(metric)
    w = W.partitionBy(*within).orderBy(key, F.desc("samples"), *name)
    # Slices are counted in hundreds per model, whatever the data size.
    return table.withColumn("slice_rank", F.row_number().over(w)).withColumn(
        "slices_tried", F.count(F.lit(1)).over(W.partitionBy(*within))
    )


def subset(df: DataFrame, kind: str, dataset: str | None = None, top: float | None = None) -> DataFrame:
    """All rows, one dataset, or the fastest fraction (speed at or above its quantile)."""
    if kind == "all":
        return df
    if kind == "dataset":
        return df.where(F.col("dataset") == dataset)
    if kind == "high_speed_top":
        if top is None or not 0.0 < top < 1.0:
            raise ValueError("top must lie strictly between 0 and 1")
        cut = bounded.quantile_columns(df, [], F.col("speed"), {"_cut": 1.0 - top})
        return df.join(F.broadcast(cut), F.col("speed") >= F.col("_cut")).drop("_cut")  # one row
    raise ValueError(f"unsupported subset {kind!r}")


def common_subset(trajectories: DataFrame, scope: str, feature: Column, q_lo: float, q_hi: float,
                  reference_model: str) -> DataFrame:
    """Metrics of every model on the same trajectories, picked by a declared quantile range of one model's rows."""
    from trackloom.functions.columns import clipped_completion

    keys = ["dataset", "scene_id", "track_id", "segment"]
    ref = trajectories.where(F.col("model") == reference_model)
    if scope != "all":
        ref = ref.where(F.col("dataset") == scope)
    ref = ref.withColumn("_v", feature)
    cut = bounded.quantile_columns(ref, [], F.col("_v"), {"value_lo": q_lo, "value_hi": q_hi})
    if q_hi >= 1.0:
        cut = cut.withColumn("value_hi", F.col("value_hi") + 1e-9)
    kept = ref.join(F.broadcast(cut), (F.col("_v") >= F.col("value_lo")) & (F.col("_v") <= F.col("value_hi")))  # one row
    rows = trajectories.join(kept.select(*keys, "value_lo", "value_hi"), keys)
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("trajectories"), F.first("value_lo").alias("value_lo"), F.first("value_hi").alias("value_hi"),
        F.avg("ade").alias("ade"), F.avg("fde").alias("fde"),
        F.avg(clipped_completion(F.col("fde"), F.col("true_path_len"))).alias("cr_clipped"),
    )
