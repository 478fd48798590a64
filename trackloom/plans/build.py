"""From canonical corpus rows to transition windows, one plan for all corpora."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from trackloom import constants as K
from trackloom.functions import columns as C
from trackloom.operators import cleaning, kinematics, neighbors, transitions
from trackloom.session import materialize

TRACK = ["dataset", "scene_id", "recording", "track_id"]


@dataclass(frozen=True)
class CorpusSpec:
    """What differs between corpora. Limits: |ax|, |ay|, |delta ax|, |delta ay|."""

    limits: tuple[float, float, float, float]
    neighbors: str = "heading"
    radius: float = 60.0
    stride: int = 12
    vehicles: tuple[str, ...] | None = None
    needs_assignment: bool = True
    half_extent: tuple[str, float, float] = ("fixed", 1.0, 2.5)
    motion: str = "given"
    rate: float = 10.0
    drop_still: bool = False


# Limits, classes and radii of the corpora.
SPECS = {
    "inD": CorpusSpec((10, 10, 8, 8), vehicles=("car", "truck_bus"), half_extent=("size", 0.75, 1.5)),
    "HighD": CorpusSpec((10, 5, 5, 2), neighbors="ids"),
    "DJI": CorpusSpec((8, 8, 6, 6), neighbors="ids", vehicles=("car", "truck", "bus")),
    "sinD": CorpusSpec((10, 10, 8, 8), vehicles=("car", "truck", "bus", "van", "motorcycle", "tricycle")),
    "NGSIM": CorpusSpec((8, 5, 6, 4), neighbors="lane", radius=100.0, half_extent=("size", 0.75, 1.5), motion="smoothed", rate=10.0),
    "CitySim": CorpusSpec((12, 12, 12, 12), motion="smoothed", rate=30.0, drop_still=True),
    "INTERACTION": CorpusSpec((10, 10, 10, 10), radius=80.0, stride=1, needs_assignment=False, half_extent=("size", 0.75, 1.5), motion="velocity"),
}


def _half(spec: CorpusSpec) -> tuple[Column, Column]:
    kind, width, length = spec.half_extent
    if kind == "fixed":
        return F.lit(width), F.lit(length)
    size = lambda c, floor: F.greatest(F.col(c) * 0.5, F.lit(floor))
    return size("width", width), size("length", length)


def prepare(corpus: str, rows: DataFrame) -> DataFrame:
    """Name the motion columns of a corpus, in metres and radians."""
    c = F.col
    if corpus in {"inD", "HighD", "DJI"}:
        df = rows.withColumns({"vx": c("xVelocity"), "vy": c("yVelocity"), "ax": c("xAcceleration"), "ay": c("yAcceleration")})
        return df.withColumn("heading", F.radians("heading")) if corpus == "inD" else df
    if corpus == "sinD":
        return rows.withColumn("agent_type", F.coalesce(c("row_agent_type"), c("agent_type"))) if "row_agent_type" in rows.columns else rows
    if corpus == "NGSIM":
        return rows.where(c("v_Class") != 1).withColumns({"width": c("width_m"), "length": c("length_m")})
    if corpus == "CitySim":
        return rows.withColumns({"x": C.pixels_to_meters(c("x")), "y": C.pixels_to_meters(c("y"))})
    return rows


# Columns that must be finite before anything else looks at a row.
FINITE = {
    "inD": ["frame", "x", "y", "heading", "width", "length", "vx", "vy", "ax", "ay"],
    "HighD": ["frame", "x", "y", "vx", "vy", "ax", "ay", *K.NEIGHBOR_ID_COLUMNS], "DJI": ["frame", "x", "y", "vx", "vy", "ax", "ay", *K.NEIGHBOR_ID_COLUMNS],
    "sinD": ["frame", "x", "y", "vx", "vy", "ax", "ay", "heading"],
    "NGSIM": ["frame", "x", "y", "speed", "v_Acc", "lane_id", "width", "length"],
    "CitySim": ["frame", "x", "y", "carCenterXft", "carCenterYft", "speed", "course", "heading"],
    "INTERACTION": ["frame", "x", "y", "vx", "vy", "heading", "width", "length"],
}


# What motion, neighbours and windows read of a row (with the ids of neighbours, where they are shipped); the rest need not travel.
READ = {*TRACK, "frame", "ordinal", "timestamp_ms", "x", "y", "vx", "vy", "ax", "ay", "heading", "speed", "course", "width", "length", "lane_id"}


def population(corpus: str, rows: DataFrame, assigned: DataFrame | None) -> DataFrame:
    """The rows windows and neighbours are built from: finite, vehicle, assigned, with motion.

    The filters stay below the neighbour join on purpose: a vehicle that is dropped here is also invisible
    as a neighbour.
    """
    return with_motion(corpus, eligible(corpus, rows, assigned))


def eligible(corpus: str, rows: DataFrame, assigned: DataFrame | None) -> DataFrame:
    """Finite rows of assigned vehicles, each frame of a track once, from the first motion on where speed is smoothed."""
    spec = SPECS[corpus]
    df = finite(corpus, rows)
    if spec.vehicles:
        df = cleaning.vehicle_rows(df, list(spec.vehicles), fold_case=corpus == "sinD")
    if spec.needs_assignment:
        if assigned is None:
            raise ValueError(f"{corpus} needs an assignment table")
        df = cleaning.assigned_rows(df, assigned)
    df = df.select(*[c for c in df.columns if c in READ or spec.neighbors == "ids" and c in K.NEIGHBOR_ID_COLUMNS])
    # A repeated (track, frame) would shift the positions that windows are cut by; the first in file order stays.
    df = cleaning.first_per_frame(df, "ordinal", TRACK) if "ordinal" in df.columns else df
    return cleaning.from_first_motion(df, "speed", TRACK) if spec.motion == "smoothed" else df


def finite(corpus: str, rows: DataFrame) -> DataFrame:
    df = prepare(corpus, rows)
    return cleaning.finite_rows(df, [c for c in FINITE[corpus] if c in df.columns])


def with_motion(corpus: str, df: DataFrame) -> DataFrame:
    """Velocities and accelerations where the corpus does not give them."""
    spec = SPECS[corpus]
    if spec.motion != "given":
        df = materialize(df.drop("speed"), "eligible")  # placed, stepped and smoothed from one copy
    if spec.motion == "smoothed":
        df = kinematics.add_kinematics(df.drop("heading"), TRACK, spec.rate, course="course" if corpus == "CitySim" else None)
        df = cleaning.finite_rows(df, ["vx", "vy", "ax", "ay"])
    elif spec.motion == "velocity":
        df = kinematics.velocity_derivative(df, TRACK)
    return df


def build_windows(corpus: str, rows: DataFrame, assigned: DataFrame | None = None, history: int = 12) -> DataFrame:
    """Consecutive windows with a boolean ``kept`` for the corpus's gates."""
    spec = SPECS[corpus]
    pop = population(corpus, rows, assigned)
    if spec.motion != "given":
        # Smoothing is Python work; neighbours and windows read its written result.
        pop = materialize(pop, "population")
    motion = ["vx", "vy", "ax", "ay"]
    if spec.neighbors == "ids":
        near = neighbors.neighbor_id_distances(pop, carry=motion)
    else:
        hw, hl = _half(spec)
        near = neighbors.sector_distances(pop, spec.radius, spec.neighbors, hw, hl, carry=motion)
    cut = transitions.cut_windows(transitions.with_features(near), spec.stride, history, counted=pop)
    kept = transitions.plausible(cut, spec.limits)
    if spec.drop_still:
        kept = kept & ~transitions.mostly_still(F.col("state"))
    return cut.withColumn("kept", kept)


def build_transitions(corpus: str, rows: DataFrame, assigned: DataFrame | None = None, split: str = "blake2b") -> DataFrame:
    """Kept windows with their split."""
    cut = build_windows(corpus, rows, assigned).where("kept").drop("kept")
    if corpus != "INTERACTION":
        return transitions.with_split(cut, split)
    ids = rows.select("scene_id", "track_id", "country", "file_stem", F.col("case_number").alias("case_id"), "track_number", "file_split").distinct()
    splits = transitions.file_splits(ids, method=split)
    ids = ids.join(splits, ["country", "file_stem", "case_id", "track_number", "file_split"]).select("scene_id", "track_id", "split")
    return cut.join(ids, ["scene_id", "track_id"])


def build_report(corpus: str, rows: DataFrame, assigned: DataFrame | None = None, history: int = 12) -> DataFrame:
    """What a build saw and left out, per scene.

    Rows by reason (class, no assignment, before the first motion or repeated), tracks too short for a window, and the
    candidate windows that were broken, implausible or kept. Rows that are not finite are not seen at all.
    """
    spec, scene, key = SPECS[corpus], ["dataset", "scene_id"], ["dataset", "scene_id", "track_id"]
    kind = F.lower("agent_type") if corpus == "sinD" else F.col("agent_type")
    vehicle = F.coalesce(kind.isin(*spec.vehicles), F.lit(False)) if spec.vehicles else F.lit(True)
    seen = finite(corpus, rows)
    if spec.needs_assignment:
        seen = seen.join(assigned.select(*key).distinct().withColumn("_assigned", F.lit(True)), key, "left")
    matched = F.col("_assigned").isNotNull() if spec.needs_assignment else F.lit(True)
    tracks = seen.groupBy(*TRACK).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~vehicle).alias("skipped_class"), F.count_if(vehicle & ~matched).alias("skipped_unassigned"))
    used = transitions.window_counts(eligible(corpus, rows, assigned), spec.stride, history, TRACK)
    # One row a track on both sides.
    tracks = tracks.join(used, TRACK, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    per_scene = tracks.groupBy(*scene).agg(
        F.sum("rows").alias("rows_seen"), F.count(F.lit(1)).alias("tracks_seen"), F.sum("skipped_class").alias("skipped_class"),
        F.sum("skipped_unassigned").alias("skipped_unassigned"),
        (F.sum("rows") - F.sum("skipped_class") - F.sum("skipped_unassigned") - F.sum("n_rows")).alias("skipped_still_or_repeated"),
        F.count_if((F.col("n_rows") > 0) & (F.col("n_rows") < history + 2)).alias("short_tracks"),
        F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates"))
    judged = build_windows(corpus, rows, assigned, history).groupBy(*scene).agg(
        F.count(F.lit(1)).alias("consecutive"), F.count_if("kept").alias("kept"))
    out = per_scene.join(judged, scene, "left").na.fill(0, ["consecutive", "kept"])
    return out.withColumns({
        "skipped_nonconsecutive": F.col("candidates") - F.col("consecutive"), "skipped_physical": F.col("consecutive") - F.col("kept"),
    }).drop("consecutive")
