"""Queries over corpus normalisation, kinematics and table round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackloom import constants as K
from trackloom.functions import columns as C, smoothing
from trackloom.operators import cleaning, kinematics, transitions
from trackloom.plans import build, views as V
from trackloom.plans.registry import query, r, rounded, with_blocks
from trackloom.session import shared_folder
from trackloom.sources import corpora, tables

KEY = ["dataset", "scene_id", "track_id"]
OUT = ["x", "y", "speed"]


def _from_path(df, corpus, path):
    return df.withColumns(corpora.scene_columns(corpus, path))


@query("S5 H5 H13", with_blocks("""
SELECT concat('NGSIM_', scene_id) AS scene_id, track_id, frame, round(y * 3048e-4, 5) AS x, round(x * 3048e-4, 5) AS y, round(vx * 3048e-4, 5) AS speed, lane_id FROM tracks""", V.TRACKS_SQL))
def normalize_ngsim(spark, d):
    t = V.tracks(spark, d)
    raw = t.select(F.col("track_id").alias("Vehicle_ID"), F.col("frame").alias("Frame_ID"), F.col("x").alias("Local_X"), F.col("y").alias("Local_Y"),
                   F.col("length").alias("v_Length"), F.col("width").alias("v_Width"), F.lit(2).alias("v_Class"), F.col("vx").alias("v_Vel"),
                   F.col("ax").alias("v_Acc"), F.col("lane_id").alias("Lane_ID"), "scene_id")
    raw = _from_path(raw, "NGSIM", F.concat(F.lit("/data/trajectories-"), "scene_id", F.lit(".csv")))
    out = corpora.normalize_ngsim(raw)
    return rounded(out.select("scene_id", "track_id", "frame", *OUT, "lane_id"), OUT, 5)


@query("S2 H13 H14", with_blocks("""
SELECT concat('inD_', lpad(substr(scene_id, 7), 2, '0')) AS scene_id, track_id, frame, round(x, 5) AS x, round(heading * 1e1, 5) AS heading,
       CASE WHEN lane_id = 1 THEN 0 ELSE lane_id - 1 END AS n_marks, round(CASE WHEN lane_id = 1 THEN 0 ELSE lane_id * (lane_id - 1) / 2e0 END, 5) AS sum_marks FROM tracks""", V.TRACKS_SQL))
def normalize_ind(spark, d):
    t = V.tracks(spark, d)
    marks = F.concat_ws(";", F.when(F.col("lane_id") > 1, F.sequence(F.lit(1), F.col("lane_id") - 1)).otherwise(F.array().cast("array<bigint>")).cast("array<string>"))
    raw = t.select(F.col("track_id").alias("trackId"), "frame", F.col("x").alias("xCenter"), F.col("y").alias("yCenter"), (F.col("heading") * 10.0).alias("heading"),
                   F.substring("scene_id", 7, 9).alias("_s"), marks.alias("marks"))
    raw = _from_path(raw, "inD", F.concat(F.lit("/data/"), F.lpad("_s", 2, "0"), F.lit("_tracks.csv")))
    out = corpora.normalize_ind(raw).withColumn("_m", C.float_list(F.col("marks")))
    return out.select("scene_id", "track_id", "frame", r("x", 5).alias("x"), r("heading", 5).alias("heading"), F.size("_m").cast("long").alias("n_marks"),
                      r(F.aggregate("_m", F.lit(0.0), lambda a, b: a + b), 5).alias("sum_marks"))


@query("S1 S6 H13", with_blocks("""
SELECT dataset, concat(dataset, '_', CASE dataset WHEN 'DJI' THEN concat('DJI_0001_', substr(scene_id, 7)) ELSE substr(scene_id, 7) END) AS scene_id,
       track_id, frame, CASE dataset WHEN 'HighD' THEN round(vx, 5) END AS speed, CASE dataset WHEN 'DJI' THEN round(heading, 5) END AS heading, lane_id
FROM (SELECT * REPLACE (kind AS dataset) FROM tracks, (SELECT unnest(['HighD', 'DJI']) AS kind))""", V.TRACKS_SQL))
def normalize_highway(spark, d):
    t = V.tracks(spark, d).select(F.col("track_id").alias("id"), "frame", "x", "y", F.col("vx").alias("xVelocity"), F.col("heading").alias("orientation"),
                                  F.col("lane_id").alias("laneId"), F.substring("scene_id", 7, 9).alias("_s"))
    high = corpora.normalize_highd(_from_path(t, "HighD", F.concat(F.lit("/data/"), "_s", F.lit("_tracks.csv"))))
    dji = corpora.normalize_dji(_from_path(t, "DJI", F.concat(F.lit("/data/DJI_0001/"), "_s", F.lit("_tracks.csv"))))
    cols = ["dataset", "scene_id", "track_id", "frame", "speed", "heading", "lane_id"]
    return rounded(high.select(*cols).unionByName(dji.select(*cols)), ["speed", "heading"], 5)


@query("S3 H13", with_blocks("""
SELECT concat('CitySim_', inter) AS scene_id, concat(recording, ':', track_id) AS track_id, frame, round(x, 5) AS x, round(vx, 5) AS speed
FROM (SELECT *, concat('Intersection', chr(65 + CAST(CAST(substr(scene_id, 7) AS BIGINT) % 5 AS INTEGER))) AS inter FROM tracks)
WHERE inter IN ('IntersectionA', 'IntersectionB', 'IntersectionD', 'IntersectionE')""", V.TRACKS_SQL))
def normalize_citysim(spark, d):
    t = V.tracks(spark, d)
    letter = F.element_at(F.array(*[F.lit(c) for c in "ABCDE"]), (F.substring("scene_id", 7, 9).cast("int") % 5 + 1))
    raw = t.select(F.col("track_id").alias("carId"), F.col("frame").alias("frameNum"), F.col("x").alias("carCenterX"), F.col("y").alias("carCenterY"),
                   F.col("vx").alias("speed"), F.degrees("heading").alias("course"), "heading", F.col("lane_id").alias("laneId"), letter.alias("_l"), F.col("recording").alias("_r"))
    raw = _from_path(raw, "CitySim", F.concat(F.lit("/data/Intersection"), "_l", F.lit("/Trajectories/"), "_r", F.lit(".csv")))
    out = corpora.normalize_citysim(raw)
    return rounded(out.select("scene_id", "track_id", "frame", "x", "speed"), ["x", "speed"], 5)


@query("S4 H13", with_blocks("""
SELECT concat('sinD_city_', scene_id) AS scene_id, track_id, min_by(CASE WHEN event_id % 3 = 0 THEN upper(agent_type) ELSE agent_type END, event_id) AS agent_type, count(*) AS n
FROM tracks GROUP BY scene_id, track_id""", V.TRACKS_SQL))
def normalize_sind(spark, d):
    t = V.tracks(spark, d)
    kind = F.when(F.col("event_id") % 3 == 0, F.upper("agent_type")).otherwise(F.col("agent_type"))
    raw = t.select("track_id", F.col("frame").alias("frame_id"), kind.alias("agent_type"), "x", "y", "vx", "vy", "ax", "ay",
                   F.col("heading").alias("heading_rad"), F.col("event_id").alias("ordinal"), F.col("scene_id").alias("_s"))
    raw = _from_path(raw, "sinD", F.concat(F.lit("/data/city/"), "_s", F.lit("/Veh_smoothed_tracks.csv")))
    return corpora.normalize_sind(raw).groupBy("scene_id", "track_id", "agent_type").agg(F.count(F.lit(1)).alias("n"))


@query("S7 H13", with_blocks("""
SELECT 'INTERACTION_USA' AS dataset, concat('DR_USA_', scene_id, '_train/case_', CAST(round_even(lane_id + 2e-1, 0) AS BIGINT)) AS scene_id,
       concat(CAST(round_even(lane_id + 2e-1, 0) AS BIGINT), ':', track_id) AS track_id, count(*) AS n, CAST(max(frame) AS BIGINT) AS last_frame
FROM tracks WHERE agent_type = 'car' AND event_id % 29 <> 0 GROUP BY scene_id, lane_id, track_id""", V.TRACKS_SQL))
def normalize_interaction(spark, d):
    t = V.tracks(spark, d)
    s = lambda c: F.col(c).cast("string")
    raw = t.select((F.col("lane_id") + 0.2).cast("string").alias("case_id"), s("track_id").alias("track_id"), s("frame").alias("frame_id"),
                   (F.col("frame") * 100).cast("string").alias("timestamp_ms"), F.initcap("agent_type").alias("agent_type"),
                   F.when(F.col("event_id") % 29 == 0, "bad").otherwise(s("x")).alias("x"), s("y").alias("y"), s("vx").alias("vx"), s("vy").alias("vy"),
                   s("heading").alias("psi_rad"), s("length").alias("length"), s("width").alias("width"), F.col("scene_id").alias("_s"))
    raw = _from_path(raw, "INTERACTION", F.concat(F.lit("/data/DR_USA_"), "_s", F.lit("_train.csv")))
    out = corpora.normalize_interaction(raw)
    return out.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("frame").alias("last_frame"))


# ---- smoothing -----------------------------------------------------------------------------------------

def _weights_sql(win: int, poly: int, deriv: int) -> str:
    w = smoothing.weights(win, poly, deriv)
    rows = ", ".join(f"({p}, {j}, {w[p, j]!r}e0)".replace("np.float64(", "").replace(")e0", "e0") if "e" not in f"{w[p, j]!r}" else f"({p}, {j}, {float(w[p, j])!r})"
                     for p in range(win) for j in range(win))
    return f"wts AS (SELECT * FROM (VALUES {rows}) w(p, j, w))"


def _smooth_sql(win: int, poly: int, deriv: int) -> str:
    return with_blocks(f"""
SELECT b.dataset, b.scene_id, b.track_id, b.frame, round(sum(w.w * v.x), 6) AS smoothed
FROM (SELECT *, greatest(0, least(p - {win // 2}, n - {win})) AS start FROM numbered) b
JOIN numbered v ON b.dataset = v.dataset AND b.scene_id = v.scene_id AND b.track_id = v.track_id AND v.p >= b.start AND v.p < b.start + {win}
JOIN wts w ON w.p = b.p - b.start AND w.j = v.p - b.start
WHERE b.n >= {win} GROUP BY 1, 2, 3, 4""", V.TRACKS_SQL, _weights_sql(win, poly, deriv),
        "numbered AS (SELECT *, row_number() OVER t - 1 AS p, count(*) OVER (PARTITION BY dataset, scene_id, track_id) AS n FROM tracks WINDOW t AS (PARTITION BY dataset, scene_id, track_id ORDER BY frame))")


@query("W13", _smooth_sql(51, 3, 0))
def smoothed_positions(spark, d):
    t = V.tracks(spark, d)
    return rounded(kinematics.smoothed(cleaning.long_enough(t, 51, KEY), KEY, "frame", "x", 51), ["smoothed"])


@query("W13", _smooth_sql(9, 2, 1))
def smoothed_derivative(spark, d):
    t = V.tracks(spark, d)
    return rounded(kinematics.smoothed(cleaning.long_enough(t, 9, KEY), KEY, "frame", "x", 9, 2, 1), ["smoothed"])


@query("W15")
def position_kinematics(spark, d):
    """Positions only in, velocities, accelerations and headings out."""
    t = V.tracks(spark, d).select(*KEY, "frame", "x", "y")
    out = kinematics.add_kinematics(t, KEY, 10.0)
    cols = ["x", "vx", "ax", "y", "vy", "ay", "heading"]
    return rounded(out.select(*KEY, "frame", *cols), cols, 4)


@query("W14 W15")
def velocity_accelerations(spark, d):
    t = V.tracks(spark, d).select(*KEY, "frame", (F.col("frame") * 100.0).alias("timestamp_ms"), "vx", "vy")
    return rounded(kinematics.velocity_derivative(t, KEY).select(*KEY, "frame", "ax", "ay"), ["ax", "ay"], 4)


# ---- whole pipelines -----------------------------------------------------------------------------------

def _raw_rows(spark, d, corpus):
    t = V.tracks(spark, d).withColumn("dataset", F.lit(corpus)).withColumn("ordinal", F.col("event_id"))
    if corpus in {"inD", "HighD", "DJI"}:
        t = t.withColumns({"xVelocity": F.col("vx"), "yVelocity": F.col("vy"), "xAcceleration": F.col("ax"), "yAcceleration": F.col("ay")}).drop("vx", "vy", "ax", "ay")
    tid = F.col("track_id").cast("long")
    for i, name in enumerate(K.NEIGHBOR_ID_COLUMNS):
        t = t.withColumn(name, F.when((tid + i) % 5 == 0, 0).otherwise(tid + i + 1))
    if corpus == "inD":
        t = t.withColumns({"heading": F.degrees("heading"), "agent_type": F.when(F.col("agent_type").isin("truck", "bus"), "truck_bus").otherwise(F.col("agent_type"))})
    if corpus in {"NGSIM", "CitySim"}:
        t = t.withColumns({"speed": F.hypot("vx", "vy"), "v_Class": F.lit(2), "width_m": F.col("width"), "length_m": F.col("length"), "course": F.degrees("heading")})
        t = t.drop("vx", "vy", "ax", "ay")
    if corpus == "INTERACTION":
        t = t.withColumns({"timestamp_ms": F.col("frame") * 100.0, "country": F.lit("USA"), "file_stem": F.col("recording"),
                           "case_number": F.lit(1).cast("long"), "track_number": tid, "file_split": F.when(F.col("lane_id") % 2 == 0, "train").otherwise("val")}).drop("ax", "ay")
    return t


def corpus_counts(spark, d, corpus):
    rows = _raw_rows(spark, d, corpus)
    assigned = rows.where("is_assigned").select(*KEY).distinct()
    out = build.build_transitions(corpus, rows, assigned, "md5")
    return out.groupBy("dataset", "scene_id", "split").agg(F.count(F.lit(1)).alias("n"))


@query("P2", with_blocks(
    "SELECT dataset, scene_id, split, count(*) AS n FROM kept GROUP BY 1, 2, 3",
    V.TRACKS_SQL, "traw AS (SELECT * REPLACE ('inD' AS dataset) FROM tracks)",
    "veh AS (SELECT * FROM traw WHERE is_assigned AND agent_type IN ('car', 'truck', 'bus'))", V.PAIRS_SQL, V.HEADING_SQL, V.SECTORS_SQL, V.WINDOWS_SQL))
def build_ind(spark, d):
    return corpus_counts(spark, d, "inD")


# How many windows are kept does not depend on the neighbours, so their SQL leaves the distances out.
_NO_GAPS = "sectors AS (SELECT *, " + ", ".join(f"CAST(NULL AS DOUBLE) AS d{i}" for i in range(8)) + " FROM veh)"
_CLASSES = "agent_type IN ('car', 'truck', 'bus')"


def _within(ax, ay, jump_x, jump_y):
    both = lambda i, limit, jump: f"abs(action[{i}]) <= {limit} AND abs(next_action[{i}]) <= {limit} AND abs(next_action[{i}] - action[{i}]) <= {jump}"
    return f"{both(1, ax, jump_x)} AND {both(2, ay, jump_y)}"


def _build_blocks(corpus, vehicles):
    return [V.TRACKS_SQL, f"traw AS (SELECT * REPLACE ('{corpus}' AS dataset) FROM tracks)",
            f"veh AS (SELECT * FROM traw WHERE is_assigned AND {vehicles})", _NO_GAPS, V.WINDOWS_SQL]


def _build_sql(corpus, vehicles, limits):
    return with_blocks(f"SELECT dataset, scene_id, split, count(*) AS n FROM split_windows WHERE {_within(*limits)} GROUP BY 1, 2, 3", *_build_blocks(corpus, vehicles))


@query("P2", _build_sql("HighD", "true", (10, 5, 5, 2)))
def build_highd(spark, d):
    return corpus_counts(spark, d, "HighD")


@query("P2", _build_sql("DJI", _CLASSES, (8, 8, 6, 6)))
def build_dji(spark, d):
    return corpus_counts(spark, d, "DJI")


@query("P2", _build_sql("sinD", _CLASSES, (10, 10, 8, 8)))
def build_sind(spark, d):
    return corpus_counts(spark, d, "sinD")


@query("A2", with_blocks(f"""
SELECT s.*, coalesce(short_tracks, 0) AS short_tracks, coalesce(candidates, 0) AS candidates, coalesce(candidates, 0) - coalesce(consecutive, 0) AS skipped_nonconsecutive,
       coalesce(consecutive, 0) - coalesce(k, 0) AS skipped_physical, coalesce(k, 0) AS kept, 0 AS skipped_still_or_repeated
FROM (SELECT dataset, scene_id, count(*) AS rows_seen, count(DISTINCT track_id) AS tracks_seen, count(*) FILTER (NOT {_CLASSES}) AS skipped_class,
             count(*) FILTER ({_CLASSES} AND NOT is_assigned) AS skipped_unassigned FROM traw GROUP BY 1, 2) s
LEFT JOIN (SELECT dataset, scene_id, count(*) FILTER (n < 14) AS short_tracks, sum(CASE WHEN n >= 14 THEN CAST(ceil((n - 13) / 12e0) AS BIGINT) ELSE 0 END) AS candidates
           FROM (SELECT dataset, scene_id, track_id, count(*) AS n FROM veh GROUP BY 1, 2, 3) GROUP BY 1, 2) c ON c.dataset = s.dataset AND c.scene_id = s.scene_id
LEFT JOIN (SELECT dataset, scene_id, count(*) AS consecutive, count(*) FILTER ({_within(8, 8, 6, 6)}) AS k FROM split_windows GROUP BY 1, 2) w
       ON w.dataset = s.dataset AND w.scene_id = s.scene_id""", *_build_blocks("DJI", _CLASSES)))
def build_report(spark, d):
    """What a build saw, left out for which reason, and kept."""
    rows = _raw_rows(spark, d, "DJI")
    return build.build_report("DJI", rows, rows.where("is_assigned").select(*KEY).distinct())


@query("P2 W15")
def build_ngsim(spark, d):
    return corpus_counts(spark, d, "NGSIM")


@query("P2 W15 F9")
def build_citysim(spark, d):
    return corpus_counts(spark, d, "CitySim")


@query("P2 H3")
def build_interaction(spark, d):
    return corpus_counts(spark, d, "INTERACTION")


# ---- tables --------------------------------------------------------------------------------------------

@query("S13 S14 P13", with_blocks(
    "SELECT dataset, count(*) AS n, round(sum(CAST(action[1] AS DOUBLE)), 4) AS total FROM kept WHERE split = 'train' AND dataset IN ('inD', 'DJI') GROUP BY 1", *V.WINDOW_BLOCKS))
def transitions_round_trip(spark, d):
    """Write transitions partitioned by split and dataset, read one split of two datasets back, unite."""
    folder = f"{shared_folder(spark)}/transitions-{uuid.uuid4().hex}"
    tables.write_transitions(V.kept_windows(spark, d), folder)
    wanted = tables.resolve_datasets(["inD", "DJI"], None)
    parts = [tables.read_transitions(spark, folder, "train", [name]) for name in wanted]
    both = tables.union_common([parts[0].withColumn("only_here", F.lit(1)), parts[1]])
    return both.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("action")[0].cast("double")), 4).alias("total"))


@query("S12 S15", with_blocks(
    "SELECT dataset, scene_id, count(DISTINCT track_id) AS n_assigned FROM tracks WHERE is_assigned GROUP BY 1, 2", V.TRACKS_SQL))
def assignments_round_trip(spark, d):
    """Write assignment records and their summary, read the assigned tracks back."""
    t = V.tracks(spark, d)
    folder = f"{shared_folder(spark)}/assignments-{uuid.uuid4().hex}"
    rows = t.select(*KEY, F.when(F.col("is_assigned"), "assigned").otherwise("unassigned").alias("status"), F.lit("p000").alias("path_id")).distinct()
    tables.write_assignments(rows, rows.groupBy("dataset", "scene_id").count(), folder)
    back = tables.read_written_assignments(spark, folder, require_path_id=True, scenes=t.select("dataset", "scene_id"))
    return back.groupBy("dataset", "scene_id").agg(F.countDistinct("track_id").alias("n_assigned"))


@query("P12", with_blocks("SELECT concat(scene_id, '/', track_id) AS track_key, count(*) AS n FROM tracks GROUP BY 1", V.TRACKS_SQL))
def track_keys(spark, d):
    return tables.track_key(V.tracks(spark, d)).groupBy("track_key").agg(F.count(F.lit(1)).alias("n"))


@query("S17 U1", with_blocks("""
SELECT dataset, track_id, count(*) AS n, round(sum(x), 3) AS total, count(*) FILTER (frame % 2 = 0) AS even_rows FROM tracks GROUP BY 1, 2""", V.TRACKS_SQL))
def written_union(spark, d):
    """Two tables with different columns united by name, written as CSV and read back."""
    t = V.tracks(spark, d)
    parts = [t.where("frame % 2 = 0").select("dataset", "track_id", "x", F.lit(1).alias("even")), t.where("frame % 2 <> 0").select("track_id", "x", "dataset")]
    folder = f"{shared_folder(spark)}/union-{uuid.uuid4().hex}"
    tables.write_csv(tables.union_all(parts, sort_columns=True), folder)
    back = spark.read.option("header", True).schema("dataset string, even int, track_id string, x double").csv(folder)
    return back.groupBy("dataset", "track_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("x"), 3).alias("total"), F.count("even").alias("even_rows"))


@query("P20 T7", with_blocks("""
SELECT e AS experiment, m AS model, concat('runs/', e, '/', m, '.pt') AS checkpoint FROM (SELECT DISTINCT dataset AS e FROM tracks), (SELECT unnest(['a', 'b']) AS m)""", V.TRACKS_SQL))
def experiment_catalogue(spark, d):
    exps = V.tracks(spark, d).select(F.col("dataset").alias("experiment")).distinct()
    models = exps.limit(1).select(F.explode(F.array(F.lit("b"), F.lit("a"))).alias("model")).withColumn(
        "checkpoint_template", F.concat(F.lit("runs/{experiment}/"), "model", F.lit(".pt")))
    return tables.in_order(tables.catalogue(exps, models), "model", ["a", "b"], "experiment")


@query("S10", with_blocks("SELECT 'NGSIM' AS dataset, concat('NGSIM_', CASE WHEN lane_id <= 2 THEN 'left' ELSE 'right' END) AS scene_id FROM tracks GROUP BY 1, 2", V.TRACKS_SQL))
def scene_listing(spark, d):
    """Scenes found from the listing of written track files."""
    t = V.tracks(spark, d)
    folder = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}"
    columns = [F.col("track_id").alias("Vehicle_ID"), F.col("frame").alias("Frame_ID"), F.col("x").alias("Local_Y"), F.col("y").alias("Local_X")]
    t.where("lane_id <= 2").select(*columns).write.option("header", True).csv(f"{folder}/trajectories-left.csv")
    t.where("lane_id > 2").select(*columns[::-1]).write.option("header", True).csv(f"{folder}/trajectories-right.csv")
    return corpora.discover_scenes(spark, {"NGSIM": folder})


@query("S8", with_blocks("""
SELECT center_id, count(*) AS n_points, round(sum(x), 3) AS sum_x, round(sum(y), 3) AS sum_y FROM (
  SELECT concat(scene_id, '/', lane_id) AS center_id, CAST(floor(frame / 50e0) AS BIGINT) AS part, avg(x) AS x, avg(y) AS y FROM tracks GROUP BY 1, 2)
GROUP BY 1 HAVING count(*) >= 2""", V.TRACKS_SQL))
def lane_centres(spark, d):
    """Centre lines of lanes (mean place for every 50 frames), written as JSON and read back; single points are left out."""
    parts = V.tracks(spark, d).groupBy(F.concat_ws("/", "scene_id", "lane_id").alias("center_id"), F.floor(F.col("frame") / 50.0).alias("part")).agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"))
    lines = parts.groupBy("center_id").agg(F.array_sort(F.collect_list(F.struct("part", "x", "y"))).alias("p"))
    folder = f"{shared_folder(spark)}/lanes-{uuid.uuid4().hex}"
    lines.select("center_id", F.transform("p", lambda v: F.array(v["x"], v["y"])).alias("center_points")).write.json(folder)
    back = corpora.read_lane_centers(spark, folder, one_document_per_file=False).select("center_id", F.explode("line").alias("p"))
    return back.groupBy("center_id").agg(F.count(F.lit(1)).alias("n_points"), r(F.sum("p.x"), 3).alias("sum_x"), r(F.sum("p.y"), 3).alias("sum_y"))
