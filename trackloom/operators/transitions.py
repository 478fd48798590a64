"""History -> action windows, stable splits, normalisation and build summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackloom import constants as K
from trackloom.functions import columns as C, hashing
from trackloom.operators import bounded
from trackloom.operators.neighbors import feature_row

TRACK = ["dataset", "scene_id", "recording", "track_id"]


def cut_windows(
    rows: DataFrame, stride: int = 12, history: int = K.HISTORY, keys: list[str] = TRACK,
    chunk_frames: int = bounded.CHUNK_FRAMES, extra: dict[str, Column] | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Cut tracks into windows of history + 2 consecutive frames.

    ``rows`` holds ``frame``, a 12-float ``features`` array and an ``action`` array per (track, frame).
    Windows start at every ``stride``-th *row* of a track in frame order; those whose frames are not
    consecutive are left out here and counted by :func:`window_counts`. ``extra`` holds additional
    per-row values to collect over the history. ``counted`` may be the same rows before the features were
    added: positions need only keys and frames, which a narrow scan delivers.

    Each track is cut into frame chunks that also see the first rows of the next chunk, so a window never
    needs more than one chunk and no track becomes one task.
    """
    span, keys = history + 2, list(keys)
    extra = extra or {}
    for name, value in extra.items():
        rows = rows.withColumn(name, value)
    sizes = (rows if counted is None else counted).groupBy(
        *keys, bounded.frame_chunk("frame", chunk_frames).alias("_chunk")
    ).agg(F.count(F.lit(1)).alias("_n"))
    offsets = bounded.totals_before(sizes, keys, ["_n"], keep=["_n"])
    cut = bounded.with_halo(rows, "frame", 0, span - 1, chunk_frames).join(offsets, [*keys, "_chunk"])
    order = Window.partitionBy(*keys, "_chunk").orderBy("frame")
    pos = (F.row_number().over(order) - 1 + F.col("_n_before")).cast("long")
    # A start sees the rows behind it in the sorted chunk; copying every row into each of its windows would make span rows of one.
    ahead = F.collect_list(F.struct("frame", "features", "action", *extra)).over(order.rowsBetween(0, span - 1))
    cut = cut.withColumns({"_pos": pos, "_rows": ahead})
    out = cut.where((F.col("_pos") % stride == 0) & (F.col("_pos") < F.col("_n_before") + F.col("_n"))).select(*keys, "_rows")
    r = F.col("_rows")
    # get() yields null instead of failing: the optimizer may look at a short window before dropping it.
    at = lambda i: F.get(r, F.lit(i))
    out = out.where((F.size(r) == span) & (at(span - 1)["frame"] - at(0)["frame"] == span - 1))

    def part(field: str, start: int, n: int) -> Column:
        return F.transform(F.slice(r, start + 1, n), lambda x: x[field])

    return out.select(
        *keys,
        at(history - 1)["frame"].alias("frame_k"),
        at(history)["frame"].alias("frame_next"),
        part("features", 0, history).alias("state"),
        at(history)["action"].alias("action"),
        part("features", 1, history).alias("next_state"),
        at(history + 1)["action"].alias("next_action"),
        *[part(name, 0, history).alias(name) for name in extra],
    )


def window_counts(rows: DataFrame, stride: int = 12, history: int = K.HISTORY, keys: list[str] = TRACK) -> DataFrame:
    """Candidate windows per track, from row counts alone."""
    n = F.col("n_rows")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "candidates",
        F.when(n >= history + 2, F.ceil((n - history - 1) / stride)).otherwise(0).cast("long"),
    )


def with_features(rows: DataFrame) -> DataFrame:
    """Add the feature vector and the float32 action of each row."""
    return rows.withColumn("features", feature_row(rows)).withColumn(
        "action", F.array(F.col("ax").cast("float"), F.col("ay").cast("float"))
    )


def plausible(windows: DataFrame, limits: tuple[float, float, float, float]) -> Column:
    return C.plausible_pair(F.col("action"), F.col("next_action"), *limits)


def mostly_still(state: Column, slow: float = 0.1) -> Column:
    """More than half of the history below walking pace."""
    count = F.size(F.filter(state, lambda f: F.hypot(f[0].cast("double"), f[2].cast("double")) < slow))
    return count > F.floor(F.size(state) / 2)


def split_name(unit: Column, ratios: tuple[float, float] = K.SPLIT_RATIOS) -> Column:
    train, val = ratios
    return F.when(unit < train, "train").when(unit < train + val, "val").otherwise("test")


def track_splits(tracks: DataFrame, method: str = "blake2b", ratios: tuple[float, float] = K.SPLIT_RATIOS) -> DataFrame:
    """Split per distinct (dataset, scene, track); ``md5`` is the variant plain SQL can repeat."""
    keys = ["dataset", "scene_id", "track_id"]
    unit = hashing.split_hash if method == "blake2b" else hashing.md5_hash
    return tracks.select(*keys).distinct().withColumn(
        "split", split_name(unit(F.concat_ws("/", *keys)), ratios)
    )


def file_splits(tracks: DataFrame, test_ratio: float = 0.5, method: str = "blake2b") -> DataFrame:
    """Official train files stay train; tracks of validation files go to test or val by hash.

    Needs country, file_stem, case_id, track_number, file_split.
    """
    keys = ["country", "file_stem", "case_id", "track_number", "file_split"]
    key = F.concat_ws("/", F.lit("INTERACTION"), "country", "file_stem", "case_id", "track_number")
    unit = (hashing.split_hash if method == "blake2b" else hashing.md5_hash)(key)
    return tracks.select(*keys).distinct().withColumn(
        "split",
        F.when(F.col("file_split") == "train", "train").when(unit < test_ratio, "test").otherwise("val"),
    )


def with_split(windows: DataFrame, method: str = "blake2b", ratios: tuple[float, float] = K.SPLIT_RATIOS) -> DataFrame:
    keys = ["dataset", "scene_id", "track_id"]
    return windows.join(track_splits(windows, method, ratios), keys)


def fraction_of_tracks(windows: DataFrame, fraction: float, method: str = "blake2b") -> DataFrame:
    """Keep whole tracks whose hash lies below ``fraction``."""
    if fraction >= 0.999999:
        return windows
    if fraction <= 0.0:
        return windows.where(F.lit(False))
    keys = ["dataset", "scene_id", "track_id"]
    unit = hashing.fraction_hash if method == "blake2b" else hashing.md5_hash
    kept = windows.select(*keys).distinct().where(unit(F.concat_ws("/", *keys)) < fraction)
    return windows.join(kept, keys, "left_semi")


def seen_and_kept(all_rows: DataFrame, kept: DataFrame, group: list[str] = ("dataset",)) -> DataFrame:
    """Rows and distinct tracks before and after a filter."""
    track = ["scene_id", "track_id"]

    def count(df: DataFrame, suffix: str) -> DataFrame:
        per_track = df.groupBy(*group, *track).agg(F.count(F.lit(1)).alias("_n"))
        return per_track.groupBy(*group).agg(
            F.sum("_n").alias(f"rows_{suffix}"), F.count(F.lit(1)).alias(f"tracks_{suffix}")
        )

    return count(all_rows, "seen").join(count(kept, "kept"), list(group), "left").na.fill(0)


def norm_stats(windows: DataFrame) -> DataFrame:
    """One row: mean and population deviation of the 12 features over all history rows, and of the action."""
    first = windows.select(F.col("action"), F.col("state"))

    def moments(arrays: DataFrame, width: int, name: str) -> DataFrame:
        cols = [F.col("v")[i].cast("double") for i in range(width)]
        sds = [F.stddev_pop(c) for c in cols]
        return arrays.agg(
            F.array(*[F.avg(c) for c in cols]).alias(f"{name}_mean"),
            F.array(*[F.when(s < 1e-6, 1.0).otherwise(s) for s in sds]).alias(f"{name}_std"),
        )

    state = moments(first.select(F.explode("state").alias("v")), len(K.FEATURES), "state")
    action = moments(first.select(F.col("action").alias("v")), 2, "action")
    return state.crossJoin(action)


def normalized(windows: DataFrame, stats: DataFrame) -> DataFrame:
    """Standardised state and action; ``stats`` is always the single row of :func:`norm_stats`."""
    df = windows.crossJoin(F.broadcast(stats))
    to_double = lambda a: F.transform(a, lambda v: v.cast("double"))
    return df.withColumn(
        "state_norm",
        F.transform("state", lambda row: C.standardize(to_double(row), F.col("state_mean"), F.col("state_std"))),
    ).withColumn(
        "action_norm", C.standardize(to_double(F.col("action")), F.col("action_mean"), F.col("action_std"))
    ).drop("state_mean", "state_std", "action_mean", "action_std")


def build_summary(counts: DataFrame, judged: DataFrame) -> DataFrame:
    """Candidates, kept windows and skip counters per scene, per dataset and overall.

    ``counts`` comes from :func:`window_counts`; ``judged`` holds consecutive windows with a boolean
    ``kept`` and a ``split``.
    """
    scene = ["dataset", "scene_id"]
    c = counts.groupBy(*scene).agg(F.sum("candidates").alias("candidates"))
    j = judged.groupBy(*scene).agg(
        F.count(F.lit(1)).alias("consecutive"),
        F.count_if("kept").alias("kept"),
        *[F.count_if(F.col("kept") & (F.col("split") == s)).alias(s) for s in ("train", "val", "test")],
    )
    per_scene = c.join(j, scene, "left").na.fill(0)
    numbers = ["candidates", "consecutive", "kept", "train", "val", "test"]
    out = per_scene.rollup(*scene).agg(*[F.sum(n).cast("long").alias(n) for n in numbers])
    return out.select(
        F.coalesce("dataset", F.lit("(all)")).alias("dataset"),
        F.coalesce("scene_id", F.lit("(all)")).alias("scene_id"),
        "candidates", "kept", "train", "val", "test",
        (F.col("candidates") - F.col("consecutive")).alias("skipped_nonconsecutive"),
        (F.col("consecutive") - F.col("kept")).alias("skipped_physical"),
    )
