"""Trajectory-shaped views over the driver tables.

The row-local expressions are plain SQL text that Spark and DuckDB read the same way; only the position of
an event within its track differs, because Spark must not put one hot track into one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.operators import bounded, neighbors, scoring, transitions
from trackloom.session import shared_folder

# An event's track: three users make one track, fifteen tracks make one scene.
TRACK_NUMBER = "CAST(floor(user_id / 3e0) AS BIGINT)"

TRACK_COLUMNS = {
    "dataset": "CASE CAST(floor(tid / 15e0) AS BIGINT) % 3 WHEN 0 THEN 'inD' WHEN 1 THEN 'DJI' ELSE 'sinD' END",
    "scene_id": "concat('scene_', CAST(CAST(floor(tid / 15e0) AS BIGINT) AS VARCHAR(20)))",
    "recording": "concat('rec_', CAST(CAST(floor(tid / 15e0) AS BIGINT) AS VARCHAR(20)))",
    "track_id": "CAST(tid AS VARCHAR(20))",
    "frame": "frame",
    "x": "frame * 9e-1 + (tid % 11) * 65e-1 + value * 5e-2",
    "y": "(tid % 7) * 35e-1 + (event_id % 5) * 1e-1",
    "vx": "value / 1e1",
    "vy": "((event_id % 5) - 2) * 1e-1",
    "ax": "((event_id % 41) - 20) * 2e-1 + (CASE WHEN event_id % 97 = 0 THEN 9e0 ELSE 0e0 END)",
    "ay": "((event_id % 17) - 8) * 3e-1",
    "heading": "(tid % 8) * 25e-2 + (event_id % 3) * 2e-2 - 1e0",
    "width": "16e-1 + (tid % 5) * 2e-1",
    "length": "4e0 + (tid % 9) * 5e-1",
    "lane_id": "(tid % 4) + 1",
    "agent_type": "CASE tid % 9 WHEN 0 THEN 'pedestrian' WHEN 1 THEN 'truck' WHEN 2 THEN 'bus' ELSE 'car' END",
    "is_assigned": "tid % 8 <> 3",
    "event_id": "event_id",
}

# Frames have gaps, of one to three frames behind every 60 to 142 rows of a track; no event is left out.
FRAME = "place + CAST(floor(place / (60e0 + tid % 83)) AS BIGINT) * (1 + tid % 3)"

_ROWS = ",\n    ".join(f"{e} AS {n}" for n, e in TRACK_COLUMNS.items())

TRACKS_SQL = f"""
tracks AS (
  SELECT {_ROWS}
  FROM (SELECT *, {FRAME} AS frame
        FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY ts, event_id) - 1 AS place
              FROM (SELECT *, {TRACK_NUMBER} AS tid FROM events)))
)"""


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


_LANDED: dict[tuple[str, str, str], str] = {}


def landed(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """Build a table once per application, write it to the shared folder and read it from there."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _LANDED:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _LANDED[key] = path
    return spark.read.parquet(_LANDED[key])


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    return landed(spark, folder, "tracks", lambda: derive_tracks(spark, folder))


def derive_tracks(spark: SparkSession, folder: str) -> DataFrame:
    events = read(spark, folder, "events").select("event_id", "ts", "user_id", "value")
    events = events.withColumn("tid", F.expr(TRACK_NUMBER))
    day = F.unix_date(F.to_date("ts")).cast("long")
    placed = bounded.positions(events, ["tid"], ["ts", "event_id"], day, "place").withColumn("frame", F.expr(FRAME))
    return placed.select(
        *[F.expr(e.replace("VARCHAR(20)", "STRING")).alias(n) for n, e in TRACK_COLUMNS.items()]
    )


def scenes(track_rows: DataFrame) -> DataFrame:
    rate = F.when(F.col("dataset") == "inD", 25.0).when(F.col("dataset") == "DJI", 30.0).otherwise(10.0)
    return track_rows.select("dataset", "scene_id").distinct().withColumn("frame_rate", rate)


VEHICLES = ["car", "truck", "bus"]


def vehicles(spark: SparkSession, folder: str) -> DataFrame:
    """Assigned vehicle rows: the population that windows and neighbours are built from."""
    return tracks(spark, folder).where(F.col("is_assigned") & F.col("agent_type").isin(VEHICLES))


RADIUS = 60.0
LIMITS = (10.0, 10.0, 8.0, 8.0)


def sectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbors.sector_distances(
        vehicles(spark, folder), RADIUS,
        half_width=F.greatest(F.col("width") * 0.5, F.lit(0.75)),
        half_length=F.greatest(F.col("length") * 0.5, F.lit(1.5)),
        carry=["vx", "vy", "ax", "ay"],
    )


def derive_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = transitions.with_features(sectors(spark, folder))
    cut = transitions.cut_windows(rows, counted=vehicles(spark, folder))
    cut = cut.withColumn("kept", transitions.plausible(cut, LIMITS))
    return transitions.with_split(cut, "md5")


def windows(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive windows with ``kept`` and ``split``, landed once."""
    return landed(spark, folder, "windows", lambda: derive_windows(spark, folder))


def kept_windows(spark: SparkSession, folder: str) -> DataFrame:
    return windows(spark, folder).where("kept").drop("kept")


MODELS = ["persistence", "damped", "biased"]


def predictions(win: DataFrame) -> DataFrame:
    """Three deterministic predictors standing in for trained models."""
    base = scoring.persistence(win)
    damped = base.withColumns({"model": F.lit("damped"), "ax_pred": F.col("ax_pred") * 0.5, "ay_pred": F.col("ay_pred") * 0.5})
    biased = base.withColumns(
        {"model": F.lit("biased"), "ax_pred": F.col("ax_pred") * 0.8 + 0.3, "ay_pred": F.col("ay_pred") * 0.8 - 0.1}
    )
    return base.unionByName(damped).unionByName(biased)


VEHICLES_SQL = """
veh AS (SELECT * FROM tracks WHERE is_assigned AND agent_type IN ('car', 'truck', 'bus'))"""

PAIRS_SQL = """
pairs AS (
  SELECT e.dataset, e.scene_id, e.recording, e.track_id, e.frame, e.lane_id, o.lane_id AS o_lane,
         e.heading, greatest(e.width * 5e-1, 75e-2) AS hw, greatest(e.length * 5e-1, 15e-1) AS hl,
         o.x - e.x AS dx, o.y - e.y AS dy
  FROM veh e JOIN veh o ON e.recording = o.recording AND e.frame = o.frame AND e.track_id <> o.track_id),
near AS (
  SELECT *, sqrt(dx * dx + dy * dy) AS d, cos(heading) * dx + sin(heading) * dy AS lon,
         cos(heading) * dy - sin(heading) * dx AS lat
  FROM pairs WHERE sqrt(dx * dx + dy * dy) > 1e-6 AND sqrt(dx * dx + dy * dy) <= 60e0)"""

HEADING_SQL = """
coded AS (
  SELECT *, CASE WHEN abs(lat) <= hw THEN CASE WHEN lon > hl THEN 0 WHEN lon < -hl THEN 1 END
                 WHEN abs(lon) <= hl THEN CASE WHEN lat > 0 THEN 3 ELSE 6 END
                 WHEN lon > 0 THEN CASE WHEN lat > 0 THEN 2 ELSE 5 END
                 ELSE CASE WHEN lat > 0 THEN 4 ELSE 7 END END AS s
  FROM near)"""

LANE_SQL = """
coded AS (
  SELECT *, CASE WHEN o_lane = lane_id THEN CASE WHEN dx > hl THEN 0 WHEN dx < -hl THEN 1 END
                 WHEN o_lane = lane_id - 1 THEN CASE WHEN abs(dx) <= hl THEN 3 WHEN dx > 0 THEN 2 ELSE 4 END
                 WHEN o_lane = lane_id + 1 THEN CASE WHEN abs(dx) <= hl THEN 6 WHEN dx > 0 THEN 5 ELSE 7 END
            END AS s
  FROM near)"""

_SECTOR_MINS = ", ".join(f"min(d) FILTER (s = {i}) AS d{i}" for i in range(8))
SECTORS_SQL = f"""
gaps AS (SELECT recording, track_id, frame, {_SECTOR_MINS} FROM coded GROUP BY recording, track_id, frame),
sectors AS (SELECT v.*, d0, d1, d2, d3, d4, d5, d6, d7 FROM veh v LEFT JOIN gaps USING (recording, track_id, frame))"""

_GAP_LIST = ", ".join(f"CAST(coalesce(d{i}, -1e0) AS FLOAT)" for i in range(8))
WINDOWS_SQL = f"""
placed AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, scene_id, recording, track_id ORDER BY frame) - 1 AS p,
         count(*) OVER (PARTITION BY dataset, scene_id, recording, track_id) AS n,
         [CAST(vx AS FLOAT), CAST(ax AS FLOAT), CAST(vy AS FLOAT), CAST(ay AS FLOAT), {_GAP_LIST}] AS ft
  FROM sectors),
cut AS (
  SELECT s.dataset, s.scene_id, s.recording, s.track_id, s.p AS p0, max(r.frame) - min(r.frame) AS span,
         list(r.ft ORDER BY r.p) AS fts, list(r.frame ORDER BY r.p) AS frs
  FROM placed s JOIN placed r ON s.recording = r.recording AND s.track_id = r.track_id AND r.p BETWEEN s.p AND s.p + 13
  WHERE s.p % 12 = 0 AND s.p < s.n - 13
  GROUP BY ALL),
acted AS (
  SELECT dataset, scene_id, recording, track_id, frs[12] AS frame_k, frs[13] AS frame_next,
         fts[1:12] AS state, fts[2:13] AS next_state, [fts[13][2], fts[13][4]] AS action,
         [fts[14][2], fts[14][4]] AS next_action
  FROM cut WHERE span = 13),
windows AS (
  SELECT *, abs(action[1]) <= 10 AND abs(action[2]) <= 10 AND abs(next_action[1]) <= 10 AND abs(next_action[2]) <= 10
         AND abs(next_action[1] - action[1]) <= 8 AND abs(next_action[2] - action[2]) <= 8 AS kept,
         CAST(concat('0x', substr(md5(concat(dataset, '/', scene_id, '/', track_id)), 1, 8)) AS BIGINT) / 4294967296e0 AS unit
  FROM acted),
split_windows AS (SELECT *, CASE WHEN unit < 8e-1 THEN 'train' WHEN unit < 8e-1 + 1e-1 THEN 'val' ELSE 'test' END AS split FROM windows),
kept AS (SELECT * FROM split_windows WHERE kept)"""

BASE = [TRACKS_SQL, VEHICLES_SQL]
WINDOW_BLOCKS = [*BASE, PAIRS_SQL, HEADING_SQL, SECTORS_SQL, WINDOWS_SQL]

PREDICTIONS_SQL = """
base AS (SELECT *, CAST(state[12][2] AS DOUBLE) AS pa, CAST(state[12][4] AS DOUBLE) AS pb,
                CAST(action[1] AS DOUBLE) AS ax_true, CAST(action[2] AS DOUBLE) AS ay_true FROM kept),
pred AS (
  SELECT *, 'persistence' AS model, pa AS ax_pred, pb AS ay_pred FROM base
  UNION ALL SELECT *, 'damped', pa * 5e-1, pb * 5e-1 FROM base
  UNION ALL SELECT *, 'biased', pa * 8e-1 + 3e-1, pb * 8e-1 - 1e-1 FROM base)"""

PREDICTION_BLOCKS = [*WINDOW_BLOCKS, PREDICTIONS_SQL]
