"""Readers for the seven trajectory corpora, all into one canonical track table.

``normalize_*`` turns a frame with the raw columns of a corpus into canonical rows; ``read_*`` scans the
files with an explicit schema and adds what only the path knows (recording, scene). A file may also be a
folder of part files with the same name, as Spark writes them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from trackloom import constants as K
from trackloom.functions import columns as C

CANONICAL = ["dataset", "scene_id", "recording", "track_id", "frame", "x", "y", "heading", "speed", "lane_id", "agent_type"]

# Raw columns and types per corpus.
_LONG, _DOUBLE, _STRING = T.LongType(), T.DoubleType(), T.StringType()
_MOTION = {"x": _DOUBLE, "y": _DOUBLE, "xVelocity": _DOUBLE, "yVelocity": _DOUBLE, "xAcceleration": _DOUBLE, "yAcceleration": _DOUBLE}
RAW = {
    "HighD": {"frame": _LONG, "id": _LONG, **_MOTION, **{c: _LONG for c in K.NEIGHBOR_ID_COLUMNS}, "laneId": _LONG},
    "inD": {"recordingId": _LONG, "trackId": _LONG, "frame": _LONG, "xCenter": _DOUBLE, "yCenter": _DOUBLE, "heading": _DOUBLE, "width": _DOUBLE,
            "length": _DOUBLE, "xVelocity": _DOUBLE, "yVelocity": _DOUBLE, "xAcceleration": _DOUBLE, "yAcceleration": _DOUBLE},
    "DJI": {"frame": _LONG, "id": _LONG, **_MOTION, **{c: _LONG for c in K.NEIGHBOR_ID_COLUMNS}, "orientation": _DOUBLE, "laneId": _LONG},
    "sinD": {"track_id": _LONG, "frame_id": _LONG, "agent_type": _STRING, "x": _DOUBLE, "y": _DOUBLE, "vx": _DOUBLE, "vy": _DOUBLE,
             "ax": _DOUBLE, "ay": _DOUBLE, "heading_rad": _DOUBLE},
    "NGSIM": {"Vehicle_ID": _LONG, "Frame_ID": _LONG, "Local_X": _DOUBLE, "Local_Y": _DOUBLE, "v_Length": _DOUBLE, "v_Width": _DOUBLE,
              "v_Class": _LONG, "v_Vel": _DOUBLE, "v_Acc": _DOUBLE, "Lane_ID": _LONG},
    "CitySim": {"frameNum": _LONG, "carId": _LONG, "carCenterX": _DOUBLE, "carCenterY": _DOUBLE, "carCenterXft": _DOUBLE, "carCenterYft": _DOUBLE,
                "speed": _DOUBLE, "course": _DOUBLE, "heading": _DOUBLE, "laneId": _LONG},
    # Coerced to numbers after the scan: bad cells drop their row instead of failing the file.
    "INTERACTION": {c: _STRING for c in ("case_id", "track_id", "frame_id", "timestamp_ms", "agent_type", "x", "y", "vx", "vy", "psi_rad", "length", "width")},
}
GLOBS = {
    "HighD": "*_tracks.csv", "inD": "*_tracks.csv", "DJI": "DJI_*/*_tracks.csv", "sinD": "*/*/Veh_smoothed_tracks.csv",
    "NGSIM": "trajectories-*.csv", "CitySim": "Intersection*/Traject*/*.csv", "INTERACTION": "DR_*_*.csv",
}
FRAME_RATES = {"HighD": 25.0, "inD": 25.0, "DJI": 30.0, "sinD": 10.0, "NGSIM": 10.0, "CitySim": 30.0, "INTERACTION": 10.0}


def _parse(path: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(path, pattern, group)


def scene_columns(corpus: str, path: Column) -> dict[str, Column]:
    """scene_id and recording from a file path."""
    prefix = _parse(path, r"/([^/_]+)_tracks\.csv")
    if corpus in {"HighD", "inD"}:
        return {"recording": prefix, "scene_id": F.concat(F.lit(f"{corpus}_"), prefix)}
    if corpus == "DJI":
        scene = F.concat(F.lit("DJI_"), _parse(path, r"/([^/]+)/[^/]+_tracks\.csv"), F.lit("_"), prefix)
        return {"recording": scene, "scene_id": scene}
    if corpus == "sinD":
        scene = F.concat(F.lit("sinD_"), _parse(path, r"/([^/]+)/([^/]+)/Veh_smoothed_tracks\.csv"), F.lit("_"),
                         _parse(path, r"/([^/]+)/Veh_smoothed_tracks\.csv"))
        return {"recording": scene, "scene_id": scene}
    if corpus == "NGSIM":
        name = _parse(path, r"/trajectories-([^/]+)\.csv")
        return {"recording": name, "scene_id": F.concat(F.lit("NGSIM_"), name)}
    if corpus == "CitySim":
        where = r"/(Intersection[^/]+)/Trajector(?:ies|y)/([^/]+)\.csv"
        return {"recording": _parse(path, where, 2), "scene_id": F.concat(F.lit("CitySim_"), _parse(path, where, 1))}
    if corpus == "INTERACTION":
        stem = _parse(path, r"/(DR_[^/]+)\.csv")
        return {"recording": stem, "scene_id": stem, "country": _parse(stem, r"^DR_([^_]+)_"), "file_split": _parse(stem, r"_([^_]+)$")}
    raise ValueError(f"unknown corpus {corpus!r}")


def matching_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files that a pattern names; for a folder of part files, the parts. Listings only."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in files.globStatus(target) or []:
        inside = files.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [f.getPath().toString() for f in inside if not f.getPath().getName().startswith(("_", "."))]
    return sorted(found)


def first_line(spark: SparkSession, path: str) -> str:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def read_csv(spark: SparkSession, pattern: str) -> DataFrame:
    """All files of a pattern as text columns, united by column name, with ``_path`` and ``ordinal`` (file order).

    One reader takes the names of a single header and applies them to all its files by position, so the files are
    grouped by their header line first (one line of each is read) and each group has a reader of its own.
    """
    groups: dict[str, list[str]] = {}
    for path in matching_files(spark, pattern):
        groups.setdefault(first_line(spark, path), []).append(path)
    if not groups:
        raise FileNotFoundError(f"no file matches {pattern}")
    parts = [spark.read.option("header", True).option("enforceSchema", False).csv(paths).withColumns(
        {"_path": F.col("_metadata.file_path"), "ordinal": F.monotonically_increasing_id()}) for paths in groups.values()]
    return reduce(lambda a, c: a.unionByName(c, allowMissingColumns=True), parts)


def scan(spark: SparkSession, corpus: str, root: str) -> DataFrame:
    """Raw rows with path columns and a source ordinal (file order, fixed before any shuffle).

    Types are applied by column name, never inferred; columns the files do not have come back null.
    """
    raw = read_csv(spark, f"{root.rstrip('/')}/{GLOBS[corpus]}")
    typed = [
        (F.col(name).try_cast(kind) if name in raw.columns else F.lit(None).cast(kind)).alias(name)
        for name, kind in RAW[corpus].items()
    ]
    df = raw.select(*typed, "_path", "ordinal")
    return df.withColumns(scene_columns(corpus, F.col("_path"))).drop("_path")


def _canonical(df: DataFrame, corpus: str, **cols: Column) -> DataFrame:
    named = {
        "dataset": F.lit(corpus), "heading": F.lit(None).cast("double"), "speed": F.lit(None).cast("double"),
        "lane_id": F.lit(None).cast("long"), "agent_type": F.lit("vehicle"), **cols,
    }
    taken = {n.lower() for n in named}
    rest = [c for c in df.columns if c.lower() not in taken]
    return df.select(*[c.alias(n) for n, c in named.items()], *rest)


def normalize_highd(raw: DataFrame) -> DataFrame:
    return _canonical(raw, "HighD", track_id=F.col("id").cast("string"), speed=F.col("xVelocity"), lane_id=F.col("laneId"))


def normalize_ind(raw: DataFrame) -> DataFrame:
    return _canonical(raw, "inD", track_id=F.col("trackId").cast("string"), x=F.col("xCenter"), y=F.col("yCenter"), heading=F.col("heading"))


def normalize_dji(raw: DataFrame) -> DataFrame:
    return _canonical(raw, "DJI", track_id=F.col("id").cast("string"), heading=F.col("orientation"), lane_id=F.col("laneId"))


def normalize_citysim(raw: DataFrame) -> DataFrame:
    """Pixel positions; the track id carries the recording; only the four listed intersections."""
    kept = raw.where(F.col("scene_id").isin([f"CitySim_{s}" for s in K.CITYSIM_SCENES]))
    return _canonical(
        kept, "CitySim", track_id=F.concat_ws(":", "recording", F.col("carId").cast("string")), frame=F.col("frameNum"), x=F.col("carCenterX"),
        y=F.col("carCenterY"), heading=F.col("heading"), speed=F.col("speed"), lane_id=F.col("laneId"))


def normalize_sind(raw: DataFrame) -> DataFrame:
    """The agent type of a track is that of its first row in file order."""
    keys = ["scene_id", "recording", "track_id"]
    kind = raw.groupBy(*keys).agg(F.min_by("agent_type", "ordinal").alias("_kind"))
    typed = raw.join(kind, keys).withColumn("row_agent_type", F.col("agent_type"))
    return _canonical(typed, "sinD", track_id=F.col("track_id").cast("string"), frame=F.col("frame_id"), heading=F.col("heading_rad"),
                      agent_type=F.col("_kind")).drop("_kind")


def normalize_ngsim(raw: DataFrame) -> DataFrame:
    """Feet to metres; x runs along the road (Local_Y)."""
    ft = C.feet_to_meters
    return _canonical(
        raw, "NGSIM", track_id=F.col("Vehicle_ID").cast("string"), frame=F.col("Frame_ID"), x=ft(F.col("Local_Y")), y=ft(F.col("Local_X")),
        speed=ft(F.col("v_Vel")), lane_id=F.col("Lane_ID"), length_m=ft(F.col("v_Length")), width_m=ft(F.col("v_Width")))


def normalize_interaction(raw: DataFrame) -> DataFrame:
    """Cars only; cells coerced to numbers, incomplete rows dropped, ids rounded half to even."""
    numeric = [c for c in RAW["INTERACTION"] if c != "agent_type"]
    df = raw.where(F.lower("agent_type") == "car").withColumns({c: F.col(c).try_cast("double") for c in numeric})
    df = df.where(C.all_finite(numeric))
    number = lambda c: F.rint(c).cast("long")
    df = df.withColumns({"case_number": number("case_id"), "track_number": number("track_id"), "file_stem": F.col("recording")})
    return _canonical(
        df, "INTERACTION", dataset=F.concat(F.lit("INTERACTION_"), "country"),
        scene_id=F.concat(F.col("file_stem"), F.lit("/case_"), F.col("case_number").cast("string")),
        track_id=F.concat_ws(":", F.col("case_number").cast("string"), F.col("track_number").cast("string")),
        frame=number("frame_id"), heading=F.col("psi_rad"), agent_type=F.lit("car"))


NORMALIZERS = {
    "HighD": normalize_highd, "inD": normalize_ind, "DJI": normalize_dji, "CitySim": normalize_citysim, "sinD": normalize_sind,
    "NGSIM": normalize_ngsim, "INTERACTION": normalize_interaction,
}


def with_meta(tracks: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of per-track metadata; its ``class`` becomes the agent type, ``vehicle`` where unknown."""
    out = tracks.drop("agent_type").join(meta, keys, "left")
    return out.withColumn("agent_type", F.coalesce("class", F.lit("vehicle"))).drop("class")


# Metadata files beside the track files, and their id column.
META = {"HighD": ("*_tracksMeta.csv", "id"), "inD": ("*_tracksMeta.csv", "trackId"), "DJI": ("DJI_*/*_tracksMeta.csv", "id")}


def read_meta(spark: SparkSession, root: str, glob: str = "*_tracksMeta.csv", id_column: str = "id", corpus: str = "HighD") -> DataFrame:
    """recording, track_id and class of every track."""
    raw = read_csv(spark, f"{root.rstrip('/')}/{glob}")
    recording = scene_columns(corpus, F.replace(F.col("_path"), F.lit("_tracksMeta.csv"), F.lit("_tracks.csv")))["recording"]
    return raw.select(recording.alias("recording"), F.col(id_column).alias("track_id"), "class")


def read_frame_rates(spark: SparkSession, root: str, default: float, glob: str = "*_recordingMeta.csv") -> DataFrame:
    """Frame rate per recording from its one-row metadata file."""
    raw = read_csv(spark, f"{root.rstrip('/')}/{glob}")
    recording = _parse(F.col("_path"), r"/([^/_]+)_recordingMeta\.csv")
    name = next((c for c in ("frameRate", "frame_rate") if c in raw.columns), None)
    rate = F.col(name).try_cast("double") if name else F.lit(None).cast("double")
    return raw.select(recording.alias("recording"), F.coalesce(rate, F.lit(default)).alias("frame_rate"), *[c for c in raw.columns if c not in (name, "_path", "ordinal")])


def read_corpus(spark: SparkSession, corpus: str, root: str) -> DataFrame:
    """Canonical tracks of one corpus; raw columns that are not canonical stay available.

    Where a corpus keeps the vehicle class in a metadata file beside the tracks, that is joined (``vehicle`` for tracks
    without an entry, or if there is no such file).
    """
    if corpus not in NORMALIZERS:
        raise ValueError(f"unknown dataset {corpus}; choices={sorted(NORMALIZERS)}")
    tracks = NORMALIZERS[corpus](scan(spark, corpus, root))
    glob, id_column = META.get(corpus, (None, None))
    if not glob or not matching_files(spark, f"{root.rstrip('/')}/{glob}"):
        return tracks
    return with_meta(tracks, read_meta(spark, root, glob, id_column, corpus), ["recording", "track_id"])


def read_lane_centers(spark: SparkSession, path: str, one_document_per_file: bool = True) -> DataFrame:
    """Lane centre lines with at least two points, from one JSON per file (or JSON lines)."""
    schema = "center_id string, center_points array<array<double>>"
    lanes = spark.read.schema(schema).option("multiLine", one_document_per_file).json(path)
    line = F.transform("center_points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return lanes.where(F.size("center_points") >= 2).select("center_id", line.alias("line"))


def discover_scenes(spark: SparkSession, roots: dict[str, str], dataset: str | None = None, scene_id: str | None = None) -> DataFrame:
    """Dataset and scene of every track file, from file listings alone."""
    out = None
    for corpus, root in roots.items():
        if dataset and corpus != dataset:
            continue
        files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{GLOBS[corpus]}").select("path")
        rows = files.select(F.lit(corpus).alias("dataset"), scene_columns(corpus, F.col("path"))["scene_id"].alias("scene_id")).distinct()
        if corpus == "CitySim":
            rows = rows.where(F.col("scene_id").isin([f"CitySim_{s}" for s in K.CITYSIM_SCENES]))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"unknown dataset {dataset}; choices={sorted(roots)}")
    return out.where(F.col("scene_id") == scene_id) if scene_id else out
