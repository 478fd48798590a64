"""Row filters, per-track filters and small table utilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackloom.functions import columns as C, hashing
from trackloom.operators.bounded import frame_chunk, positions, quantile_columns, top_per_group

TRACK = ["dataset", "recording", "track_id"]


def finite_rows(df: DataFrame, columns: list[str], skip: set[str] = frozenset()) -> DataFrame:
    return df.where(C.all_finite([c for c in columns if c not in skip]))


def vehicle_rows(df: DataFrame, classes: list[str], column: str = "agent_type", fold_case: bool = False) -> DataFrame:
    c = F.col(column)
    return df.where((F.lower(c) if fold_case else c).isin(list(classes)))


def assigned_rows(df: DataFrame, assigned: DataFrame, keys: list[str] = ("dataset", "scene_id", "track_id")) -> DataFrame:
    return df.join(assigned.select(*keys).distinct(), list(keys), "left_semi")


def track_sizes(df: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame")
    )


def long_enough(df: DataFrame, min_rows: int, keys: list[str] = TRACK) -> DataFrame:
    """Keep tracks with enough rows; the count is combined before its shuffle."""
    keep = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).drop("_n")
    return df.join(keep, list(keys), "left_semi")


def eligible_tracks(tracks: DataFrame, scenes: DataFrame, min_duration_s: float = 3.0,
                    require_boundary: bool = False, keys: list[str] = ("dataset", "scene_id", "track_id")) -> DataFrame:
    """Keys of vehicle tracks that are long enough, fully finite and, if asked, run from edge to edge."""
    keys = list(keys)
    per_track = tracks.groupBy(*keys).agg(
        F.min(C.is_route_vehicle(F.col("agent_type"))).alias("_vehicle"),
        F.count(F.lit(1)).alias("n_points"),
        F.min(C.finite("x") & C.finite("y")).alias("_finite"),
        F.min_by(F.struct("x", "y"), "frame").alias("_start"),
        F.max_by(F.struct("x", "y"), "frame").alias("_end"),
    )
    need = F.greatest(F.lit(2), F.rint(F.col("frame_rate") * min_duration_s).cast("long"))
    out = per_track.join(scenes.select("dataset", "scene_id", "frame_rate"), ["dataset", "scene_id"]).where(
        F.col("_vehicle") & F.col("_finite") & (F.col("n_points") >= need)
    )
    if require_boundary:
        box = scene_box(long_enough(tracks, 2, keys))
        out = out.join(box, ["dataset", "scene_id"]).where(_edge_to_edge(F.col("_start"), F.col("_end")))
    return out.select(*keys, "n_points")


def _edge_to_edge(start: Column, end: Column, margin: float = 0.08, span: float = 0.15) -> Column:
    def near(p: Column) -> Column:
        mx, my = (F.col("x_hi") - F.col("x_lo")) * margin, (F.col("y_hi") - F.col("y_lo")) * margin
        return (
            (p["x"] <= F.col("x_lo") + mx) | (p["x"] >= F.col("x_hi") - mx)
            | (p["y"] <= F.col("y_lo") + my) | (p["y"] >= F.col("y_hi") - my)
        )

    moved = F.hypot(end["x"] - start["x"], end["y"] - start["y"])
    return near(start) & near(end) & (moved > F.col("diagonal") * span)


def scene_box(points: DataFrame, keys: list[str] = ("dataset", "scene_id")) -> DataFrame:
    """p1-p99 box and its diagonal per scene."""
    keys = list(keys)
    ends = {"lo": 0.01, "hi": 0.99}
    box = quantile_columns(points, keys, F.col("x"), {f"x_{k}": p for k, p in ends.items()}).join(
        quantile_columns(points, keys, F.col("y"), {f"y_{k}": p for k, p in ends.items()}), keys
    )
    return box.withColumn(
        "diagonal", F.hypot(F.col("x_hi") - F.col("x_lo"), F.col("y_hi") - F.col("y_lo"))
    )


def first_per_frame(df: DataFrame, ordinal: str, keys: list[str] = TRACK) -> DataFrame:
    """Keep the first row of every (track, frame) in source order; copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in {*keys, "frame"}]
    picked = df.groupBy(*keys, "frame").agg(F.min_by(F.struct(*rest), F.col(ordinal)).alias("_r"))
    return picked.select(*keys, "frame", *[F.col("_r")[c].alias(c) for c in rest])


def from_first_motion(df: DataFrame, speed: str = "speed", keys: list[str] = TRACK) -> DataFrame:
    """Drop leading rows until the track moves; tracks that never move disappear."""
    moving = C.finite(speed) & (F.abs(F.col(speed)) > 1e-6)
    start = df.where(moving).groupBy(*keys).agg(F.min("frame").alias("_start"))
    return df.join(start, list(keys)).where(F.col("frame") >= F.col("_start")).drop("_start")


def normalized_ids(df: DataFrame, column: str) -> DataFrame:
    """Rows whose id is an integer, with the id as a long."""
    return df.withColumn(column, F.expr(f"try_cast({column} AS BIGINT)")).where(F.col(column).isNotNull())


def first_rows(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Sample cap: everything when n is not positive, else the first n rows in key order."""
    return df if n <= 0 else df.orderBy(*keys).limit(n)


def head_per_source(df: DataFrame, source: list[str], order: list[str], n: int) -> DataFrame:
    """First n rows of each source in file order. A count per chunk keeps the ranking bounded."""
    if n <= 0:
        return df
    return positions(df, source, order, frame_chunk(order[0]), "_at").where(F.col("_at") < n).drop("_at")


def seeded_sample(keys: DataFrame, columns: list[str], n: int, seed: int = 42, within: list[str] = ()) -> DataFrame:
    """n rows without replacement, fixed by a hash of their key; ties by key."""
    ranked = keys.withColumn("_h", hashing.md5_code(F.concat_ws("/", *[F.col(c).cast("string") for c in columns], F.lit(str(seed)))))
    order = [F.col("_h"), *[F.col(c) for c in columns]]
    if not within:
        return ranked.orderBy(*order).limit(n).drop("_h")
    return top_per_group(ranked, list(within), order, n).drop("_h")


def requested(df: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows for an ordered list of keys (first mention wins) and the keys that do not exist.

    ``wanted`` has columns ``key`` and ``position``.
    """
    order = wanted.groupBy(key).agg(F.min("position").alias("position"))
    return df.join(order, key).orderBy("position"), order.join(df, key, "left_anti").select(key, "position")


def alignment_gate(df: DataFrame, min_frames: int = 80, max_frames: int = 520, min_length: float = 8.0,
                   max_ratio_delta: float = 0.30, max_mean_error: float = 0.18) -> DataFrame:
    """Adds ``alignment_accepted`` from frame count, path length, length ratio and normalised mean error."""
    return df.withColumn(
        "alignment_accepted",
        F.col("n_frames").between(min_frames, max_frames)
        & (F.col("path_len") >= min_length)
        & (F.abs(F.col("length_ratio") - 1.0) <= max_ratio_delta)
        & (F.col("norm_mean_error") <= max_mean_error),
    )


def demo_subset(tracks: DataFrame, meta: DataFrame, recording_meta: DataFrame, assigned: DataFrame,
                first: int, last: int, vehicle_classes: list[str], min_frames: int = 14):
    """Cut a frame range of assigned vehicles; returns the rows and both rewritten meta tables."""
    keys = ["recording", "track_id"]
    wanted = meta.where(F.col("class").isin(vehicle_classes)).select(*keys).intersect(assigned.select(*keys))
    rows = tracks.where(F.col("frame").between(first, last)).join(wanted, keys, "left_semi")
    rows = long_enough(rows, min_frames, keys)
    rows = positions(rows, keys, ["frame"], name="track_lifetime")
    track_meta = rewrite_track_meta(meta, rows, keys)
    return rows, track_meta, rewrite_recording_meta(recording_meta, track_meta, first, last, vehicle_classes)


def rewrite_track_meta(meta: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    sizes = rows.groupBy(*keys).agg(
        F.min("frame").alias("initialFrame"), F.max("frame").alias("finalFrame"), F.count(F.lit(1)).alias("numFrames")
    )
    return meta.drop("initialFrame", "finalFrame", "numFrames").join(sizes, keys)


def rewrite_recording_meta(recording_meta: DataFrame, track_meta: DataFrame, first: int, last: int,
                           vehicle_classes: list[str]) -> DataFrame:
    is_vehicle = F.col("class").isin(vehicle_classes)
    counts = track_meta.groupBy("recording").agg(
        F.count(F.lit(1)).alias("numTracks"),
        F.count_if(is_vehicle).alias("numVehicles"),
        F.count_if(~is_vehicle).alias("numVRUs"),
    )
    frames = float(max(0, last - first + 1))
    rate = F.col("frameRate")
    return recording_meta.drop("duration", "numTracks", "numVehicles", "numVRUs").join(counts, "recording").withColumn(
        "duration", F.when(rate > 0, F.lit(frames) / rate).otherwise(0.0)
    )
