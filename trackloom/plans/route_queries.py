"""Queries over geometry, route mining and matching."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackloom.operators import bounded, cleaning, clustering, geometry as G, matching, medoids, routes
from trackloom.plans import views as V
from trackloom.plans.registry import query, r, rounded, with_blocks
from trackloom.session import materialize, shared_folder

SCENE = ["dataset", "scene_id"]
KEY = [*SCENE, "track_id"]

# Smooth test lines: the driver's events have no real motion, so lines follow a slow curve that depends on
# the track, plus the event's own small offset.
LINES_SQL = """
lines AS (
  SELECT dataset, scene_id, track_id, frame AS seq, agent_type, is_assigned,
         frame * 9e-1 + (event_id % 5) * 5e-2 AS x,
         (CAST(track_id AS BIGINT) % 4) * 12e0 + (CAST(track_id AS BIGINT) % 3) * 2e-1 + frame * frame * 2e-3 * ((CAST(track_id AS BIGINT) % 4) - 1) + (event_id % 3) * 1e-1 AS y
  FROM tracks)"""


def lines(spark, d):
    t = F.col("track_id").cast("long")
    return V.tracks(spark, d).select(
        *KEY, F.col("frame").alias("seq"), "agent_type", "is_assigned",
        (F.col("frame") * 0.9 + (F.col("event_id") % 5) * 0.05).alias("x"),
        ((t % 4) * 12.0 + (t % 3) * 0.2 + F.col("frame") * F.col("frame") * 0.002 * ((t % 4) - 1) + (F.col("event_id") % 3) * 0.1).alias("y"))


def line_scenes(spark, d):
    return V.scenes(V.tracks(spark, d)).withColumn("unit", F.lit("meter"))


_ARC = """
prevs AS (SELECT *, lag(x) OVER t AS px, lag(y) OVER t AS py FROM lines WINDOW t AS (PARTITION BY dataset, scene_id, track_id ORDER BY seq)),
arcs AS (SELECT *, coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0) AS step_len FROM prevs),
arc AS (SELECT *, sum(step_len) OVER (PARTITION BY dataset, scene_id, track_id ORDER BY seq) AS s FROM arcs),
tot AS (SELECT dataset, scene_id, track_id, max(s) AS total FROM arc GROUP BY 1, 2, 3)"""


def _resample_sql(n: int, name: str) -> str:
    return f"""
{name} AS (
  SELECT dataset, scene_id, track_id, k AS seq, min_by(px + (x - px) * u, (excess, s)) AS x, min_by(py + (y - py) * u, (excess, s)) AS y FROM (
    SELECT a.*, g.k, greatest(s - step_len - k * total / {n - 1}e0, k * total / {n - 1}e0 - s, 0) AS excess,
           greatest(0, least(1, (k * total / {n - 1}e0 - (s - step_len)) / step_len)) AS u
    FROM arc a JOIN tot USING (dataset, scene_id, track_id) JOIN (SELECT unnest(range({n})) AS k) g
      ON g.k * total / {n - 1}e0 >= s - step_len - 1e-6 AND g.k * total / {n - 1}e0 <= s + 1e-6
    WHERE step_len > 1e-9) GROUP BY 1, 2, 3, 4)"""


@query("W16 H16", with_blocks("SELECT dataset, scene_id, track_id, seq, round(s, 5) AS s FROM arc", V.TRACKS_SQL, LINES_SQL, _ARC))
def arc_lengths(spark, d):
    return rounded(G.arc_length(lines(spark, d), KEY).select(*KEY, "seq", "s"), ["s"], 5)


@query("W17 R1", with_blocks(
    "SELECT dataset, scene_id, track_id, seq, round(x, 5) AS x, round(y, 5) AS y FROM r50", V.TRACKS_SQL, LINES_SQL, _ARC, _resample_sql(50, "r50")))
def resampled_tracks(spark, d):
    return rounded(G.resample(lines(spark, d), KEY, 50), ["x", "y"], 5)


@query("P5", with_blocks("""
SELECT dataset, scene_id, track_id, count(*) AS n FROM (
  SELECT *, lag(x) OVER t AS px, lag(y) OVER t AS py FROM (SELECT dataset, scene_id, track_id, frame AS seq, floor(x / 2e1) AS x, floor(y / 1e1) AS y FROM tracks WHERE event_id % 53 <> 0)
  WINDOW t AS (PARTITION BY dataset, scene_id, track_id ORDER BY seq))
WHERE px IS NULL OR sqrt((x - px) * (x - px) + (y - py) * (y - py)) > 1e-9 GROUP BY 1, 2, 3""", V.TRACKS_SQL))
def clean_polylines(spark, d):
    t = V.tracks(spark, d).select(
        *KEY, F.col("frame").alias("seq"), F.when(F.col("event_id") % 53 == 0, float("nan")).otherwise(F.floor(F.col("x") / 20.0).cast("double")).alias("x"),
        F.floor(F.col("y") / 10.0).cast("double").alias("y"))
    return G.clean_polyline(t, KEY).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


@query("W12 W14", with_blocks("""
SELECT dataset, scene_id, track_id, seq, round(CASE WHEN px IS NOT NULL AND nx IS NOT NULL
    THEN ((seq - ps) * (seq - ps) * nx + ((ns - seq) * (ns - seq) - (seq - ps) * (seq - ps)) * x - (ns - seq) * (ns - seq) * px) / ((seq - ps) * (ns - seq) * (ns - ps) * 1e0)
    WHEN nx IS NOT NULL THEN (nx - x) / (ns - seq) WHEN px IS NOT NULL THEN (x - px) / (seq - ps) ELSE 0 END, 5) AS gradient, round(dt, 6) AS dt
FROM (SELECT *, lag(x) OVER t AS px, lead(x) OVER t AS nx, lag(seq) OVER t AS ps, lead(seq) OVER t AS ns FROM lines WINDOW t AS (PARTITION BY dataset, scene_id, track_id ORDER BY seq))
JOIN (SELECT dataset, scene_id, track_id, quantile_cont(step, 5e-1) / 1e1 AS dt FROM (
  SELECT *, seq - lag(seq) OVER (PARTITION BY dataset, scene_id, track_id ORDER BY seq) AS step FROM lines) GROUP BY 1, 2, 3) USING (dataset, scene_id, track_id)""",
    V.TRACKS_SQL, LINES_SQL))
def numeric_gradients(spark, d):
    from trackloom.operators.kinematics import time_step

    rows = lines(spark, d)
    g = G.numeric_gradient(rows, KEY, "seq", "x", "seq")
    dt = time_step(rows, KEY, "seq", 10.0)
    return rounded(g.join(dt, KEY).select(*KEY, "seq", "gradient", "dt"), ["gradient", "dt"], 5)


def mined_paths(spark, d):
    """One route per scene and curve family: the mean line of all its tracks, sampled like final paths."""
    def build():
        rows = G.resample(lines(spark, d), KEY, 50).withColumn("cluster_id", F.col("track_id").cast("long") % 4)
        keys = [*SCENE, "cluster_id"]
        mean = rows.groupBy(*keys, "seq").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("size"))
        return routes.final_paths(G.to_array(mean, [*keys, "size"]))
    return V.landed(spark, d, "paths", build)


_PATHS = f"""
p50 AS (SELECT dataset, scene_id, CAST(CAST(track_id AS BIGINT) % 4 AS VARCHAR) AS track_id, seq, avg(x) AS x, avg(y) AS y FROM r50 GROUP BY 1, 2, 3, 4)"""


def _chain(n: int, source: str, name: str) -> str:
    """Resample again with its own arc length."""
    return f"""
{name}_a AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER t, 2) + pow(y - lag(y) OVER t, 2)), 0) AS step_len, lag(x) OVER t AS px, lag(y) OVER t AS py FROM {source} WINDOW t AS (PARTITION BY dataset, scene_id, track_id ORDER BY seq)),
{name}_b AS (SELECT *, sum(step_len) OVER (PARTITION BY dataset, scene_id, track_id ORDER BY seq) AS s, sum(step_len) OVER (PARTITION BY dataset, scene_id, track_id) AS total FROM {name}_a),
{name} AS (SELECT dataset, scene_id, track_id, k AS seq, min_by(px + (x - px) * u, (excess, s)) AS x, min_by(py + (y - py) * u, (excess, s)) AS y FROM (
  SELECT a.* EXCLUDE (seq), g.k, greatest(s - step_len - k * total / {n - 1}e0, k * total / {n - 1}e0 - s, 0) AS excess, greatest(0, least(1, (k * total / {n - 1}e0 - (s - step_len)) / step_len)) AS u
  FROM {name}_b a JOIN (SELECT unnest(range({n})) AS k) g ON g.k * total / {n - 1}e0 >= s - step_len - 1e-6 AND g.k * total / {n - 1}e0 <= s + 1e-6 WHERE step_len > 1e-9) GROUP BY 1, 2, 3, 4)"""


_GRAD = lambda c: f"CASE WHEN lag({c}) OVER t IS NULL THEN lead({c}) OVER t - {c} WHEN lead({c}) OVER t IS NULL THEN {c} - lag({c}) OVER t ELSE (lead({c}) OVER t - lag({c}) OVER t) / 2 END"
_T = "WINDOW t AS (PARTITION BY dataset, scene_id, track_id ORDER BY seq)"
_GEOMETRY = f"""
{_chain(12, 'p50', 'p12')}, {_chain(100, 'p12', 'p100')},
ga AS (SELECT *, sum(d) OVER (PARTITION BY dataset, scene_id, track_id ORDER BY seq) AS s FROM (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER t, 2) + pow(y - lag(y) OVER t, 2)), 0) AS d FROM p100 {_T})),
gb AS (SELECT *, {_GRAD('x')} AS gx, {_GRAD('y')} AS gy, greatest({_GRAD('s')}, 1e-6) AS ds FROM ga {_T}),
gc AS (SELECT *, gx / greatest(sqrt(gx * gx + gy * gy), 1e-9) AS tx, gy / greatest(sqrt(gx * gx + gy * gy), 1e-9) AS ty, gx / ds AS ddx0, gy / ds AS ddy0 FROM gb),
gd AS (SELECT *, ({_GRAD('ddx0')}) / ds AS dd_x, ({_GRAD('ddy0')}) / ds AS dd_y FROM gc {_T}),
geo AS (SELECT *, (ddx0 * dd_y - ddy0 * dd_x) / greatest(pow(ddx0 * ddx0 + ddy0 * ddy0, 15e-1), 1e-9) AS kappa,
        concat('p', lpad(CAST(dense_rank() OVER (PARTITION BY dataset, scene_id ORDER BY CAST(track_id AS BIGINT)) - 1 AS VARCHAR), 3, '0')) AS path_id FROM gd)"""
PATH_BLOCKS = [V.TRACKS_SQL, LINES_SQL, _ARC, _resample_sql(50, "r50"), _PATHS, _GEOMETRY]
_GEO_COLS = ["x", "y", "s", "tx", "ty"]


@query("R8 W18 Q1", with_blocks(
    "SELECT dataset, scene_id, path_id, seq, " + ", ".join(f"round({c}, 4) AS {c}" for c in _GEO_COLS) + ", round(kappa, 3) AS kappa FROM geo", *PATH_BLOCKS))
def final_paths(spark, d):
    out = mined_paths(spark, d).select(*SCENE, "path_id", "seq", *_GEO_COLS, "kappa")
    return rounded(rounded(out, _GEO_COLS, 4), ["kappa"], 3)


@query("A22", with_blocks("""
SELECT dataset, scene_id, cluster_id, min_by(track_id, (round(total, 6), track_id)) AS track_id, round(min(total), 4) AS distance_sum, count(*) AS size FROM (
  SELECT dataset, scene_id, cluster_id, track_id, sum(sqrt(square)) AS total FROM (
    SELECT a.dataset, a.scene_id, CAST(a.track_id AS BIGINT) % 4 AS cluster_id, a.track_id, b.track_id AS other, sum(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS square
    FROM r50 a JOIN r50 b ON a.dataset = b.dataset AND a.scene_id = b.scene_id AND a.seq = b.seq AND CAST(a.track_id AS BIGINT) % 4 = CAST(b.track_id AS BIGINT) % 4 GROUP BY 1, 2, 3, 4, 5)
  GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""", V.TRACKS_SQL, LINES_SQL, _ARC, _resample_sql(50, "r50")))
def route_medoids(spark, d):
    """The most central track of every scene and curve family."""
    t = lines(spark, d).withColumnRenamed("seq", "frame")
    vectors = routes.track_vectors(t, t).withColumn("cluster_id", F.col("track_id").cast("long") % 4)
    out = medoids.medoids(vectors.select(*SCENE, "cluster_id", F.col("track_id").alias("id"), "vector"), [*SCENE, "cluster_id"])
    return rounded(out.drop("vector").withColumnRenamed("id", "track_id"), ["distance_sum"], 4)


@query("A22", """
SELECT label, min_by(vec_id, (round(total, 6), vec_id)) AS vec_id, round(min(total), 4) AS distance_sum, count(*) AS size FROM (
  SELECT a.label, a.vec_id, sum(list_distance(a.v, b.v)) AS total
  FROM (SELECT label, vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings) a
  JOIN (SELECT label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings) b ON a.label = b.label GROUP BY 1, 2) GROUP BY 1""")
def label_medoids(spark, d):
    """The most central vector of every label."""
    p = embedding_points(spark, d)
    out = medoids.medoids(p.select("label", "id", "vector"), ["label"])
    return rounded(out.select("label", F.col("id").cast("long").alias("vec_id"), "distance_sum", "size"), ["distance_sum"], 4)


@query("J8", with_blocks("""
SELECT dataset, scene_id, path_id, other_path_id, seq, round(abs(sd), 4) AS distance, topology FROM (
  SELECT a.dataset, a.scene_id, a.path_id, b.path_id AS other_path_id, a.seq, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS sd,
         CASE WHEN a.path_id = b.path_id THEN 0e0 ELSE 4e0 END AS topology
  FROM geo a JOIN geo b ON a.dataset = b.dataset AND a.scene_id = b.scene_id GROUP BY 1, 2, 3, 4, 5, 7)""", *PATH_BLOCKS))
def between_paths(spark, d):
    out = G.between_paths(mined_paths(spark, d))
    return out.select(*SCENE, "path_id", "other_path_id", "seq", r(F.abs("signed_distance"), 4).alias("distance"), "topology")


_GAPS = f"""
{_resample_sql(100, 't100')}, {_chain(100, 'geo_id', 'q100')},
gaps AS (SELECT t.dataset, t.scene_id, t.track_id, p.track_id AS path_id, avg(sqrt((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y))) AS mean_gap
         FROM t100 t JOIN q100 p ON t.dataset = p.dataset AND t.scene_id = p.scene_id AND t.seq = p.seq GROUP BY 1, 2, 3, 4)"""
_GEO_ID = "geo_id AS (SELECT dataset, scene_id, path_id AS track_id, seq, x, y FROM geo)"
GAP_BLOCKS = [*PATH_BLOCKS, _GEO_ID, _GAPS]


def gaps(spark, d):
    return V.landed(spark, d, "gaps", lambda: routes.track_path_gaps(
        lines(spark, d).withColumnRenamed("seq", "frame"), routes.path_lines(mined_paths(spark, d))))


@query("J7 P6", with_blocks("""
SELECT dataset, scene_id, count(*) AS total, count(*) FILTER (gap <= 35e-1) AS assigned, round(avg(gap), 4) AS mean_distance, round(quantile_cont(gap, 95e-2), 4) AS p95_distance
FROM (SELECT dataset, scene_id, track_id, min(mean_gap) AS gap FROM gaps GROUP BY 1, 2, 3) GROUP BY 1, 2""", *GAP_BLOCKS))
def path_coverage(spark, d):
    out = routes.coverage(gaps(spark, d)).drop("coverage")
    return rounded(out, ["mean_distance", "p95_distance"], 4)


_QUALITY = """
quality AS (
SELECT g.dataset, g.scene_id, g.path_id, round(min(mean_gap), 4) AS min_gap_to_track, min_by(track_id, (mean_gap, track_id)) AS nearest_track_id,
       max(c.coverage) AS coverage, any_value(x.ok) AS geometry_ok
FROM gaps g JOIN (SELECT dataset, scene_id, round(avg(CASE WHEN gap <= 35e-1 THEN 1e0 ELSE 0e0 END), 5) AS coverage FROM (
    SELECT dataset, scene_id, track_id, min(mean_gap) AS gap FROM gaps GROUP BY 1, 2, 3) GROUP BY 1, 2) c ON c.dataset = g.dataset AND c.scene_id = g.scene_id
JOIN (SELECT a.dataset, a.scene_id, a.path_id, NOT bool_or(b.seq >= a.seq + 2
     AND (CASE WHEN abs((b.ny - a.y) * (b.x - a.x) - (b.y - a.y) * (b.nx - a.x)) > 1e-9 THEN sign((b.ny - a.y) * (b.x - a.x) - (b.y - a.y) * (b.nx - a.x)) ELSE 0 END) * (CASE WHEN abs((b.ny - a.ny) * (b.x - a.nx) - (b.y - a.ny) * (b.nx - a.nx)) > 1e-9 THEN sign((b.ny - a.ny) * (b.x - a.nx) - (b.y - a.ny) * (b.nx - a.nx)) ELSE 0 END) < 0
     AND (CASE WHEN abs((b.y - a.y) * (a.nx - a.x) - (a.ny - a.y) * (b.x - a.x)) > 1e-9 THEN sign((b.y - a.y) * (a.nx - a.x) - (a.ny - a.y) * (b.x - a.x)) ELSE 0 END) * (CASE WHEN abs((b.ny - a.y) * (a.nx - a.x) - (a.ny - a.y) * (b.nx - a.x)) > 1e-9 THEN sign((b.ny - a.y) * (a.nx - a.x) - (a.ny - a.y) * (b.nx - a.x)) ELSE 0 END) < 0) AS ok
  FROM seg a JOIN seg b ON a.dataset = b.dataset AND a.scene_id = b.scene_id AND a.path_id = b.path_id GROUP BY 1, 2, 3) x
  ON x.dataset = g.dataset AND x.scene_id = g.scene_id AND x.path_id = g.path_id
GROUP BY 1, 2, 3)"""
_SEG = "seg AS (SELECT * FROM (SELECT *, lead(x) OVER t AS nx, lead(y) OVER t AS ny FROM geo WINDOW t AS (PARTITION BY dataset, scene_id, path_id ORDER BY seq)) WHERE nx IS NOT NULL)"
QUALITY_BLOCKS = [*GAP_BLOCKS, _SEG, _QUALITY]


@query("J6 Q2 H17", with_blocks("""
SELECT *, true AS metadata_ok, min_gap_to_track >= 1e-1 AS not_identical_to_raw_track, 100 AS n_points,
       geometry_ok AND min_gap_to_track >= 1e-1 AND coverage >= 9e-1 AS valid FROM quality""", *QUALITY_BLOCKS))
def quality_report(spark, d):
    out = routes.quality_report(mined_paths(spark, d), gaps(spark, d), line_scenes(spark, d), enforce_uniqueness=True)
    return rounded(rounded(out, ["min_gap_to_track"], 4), ["coverage"], 5)


@query("S16 Q3 Q4", with_blocks("""
SELECT g.dataset, g.scene_id, g.path_id, count(*) AS n_points, round(sum(g.x), 3) AS sum_x, any_value(q.nearest_track_id) AS nearest_track_id, any_value(q.coverage) AS coverage,
       any_value(q.refused) AS refused_for_coverage
FROM geo g JOIN (SELECT *, bool_or(fit AND coverage < 9e-1) OVER () AS refused FROM (
    SELECT *, bool_and(geometry_ok AND min_gap_to_track >= 1e-1) OVER (PARTITION BY dataset, scene_id) AS fit FROM quality)) q
  ON g.dataset = q.dataset AND g.scene_id = q.scene_id AND g.path_id = q.path_id WHERE q.fit GROUP BY 1, 2, 3""", *QUALITY_BLOCKS))
def saved_paths(spark, d):
    """Paths of scenes that pass all checks of the paths themselves, saved with their report and read back.

    The gate is tried both ways: with coverage required it refuses if any of these scenes is covered too little.
    """
    points = mined_paths(spark, d)
    report = materialize(routes.quality_report(points, gaps(spark, d), line_scenes(spark, d), enforce_uniqueness=True), "path-report")
    failing = report.where("NOT (geometry_ok AND metadata_ok AND not_identical_to_raw_track)").select(*SCENE).distinct()
    points, report = points.join(failing, SCENE, "left_anti"), report.join(failing, SCENE, "left_anti")
    folder = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    try:
        routes.save_paths(points, report, f"{folder}/covered", require_coverage=True)
        refused = False
    except ValueError:
        refused = True
    routes.save_paths(points, report, f"{folder}/all", require_coverage=False)
    back = spark.read.schema("path_id string, x double, nearest_track_id string, coverage double, dataset string, scene_id string").parquet(f"{folder}/all/paths")
    return back.groupBy(*SCENE, "path_id").agg(
        F.count(F.lit(1)).alias("n_points"), r(F.sum("x"), 3).alias("sum_x"), F.first("nearest_track_id").alias("nearest_track_id"),
        r(F.first("coverage"), 5).alias("coverage"), F.lit(refused).alias("refused_for_coverage"))


def sampled(spark, d):
    def build():
        out, _ = matching.sampled_tracks(lines(spark, d).withColumnRenamed("seq", "frame"), line_scenes(spark, d))
        return out
    return V.landed(spark, d, "sampled", build)


_COARSE = f"""
{_resample_sql(80, 't80')},
veht AS (SELECT DISTINCT dataset, scene_id, track_id FROM lines WHERE agent_type IN ('car', 'truck', 'bus')),
tp AS (SELECT t.* FROM t80 t JOIN veht USING (dataset, scene_id, track_id) WHERE seq % 6 = 0),
vp AS (SELECT dataset, scene_id, path_id, false AS invert, seq, x, y FROM geo WHERE seq % 4 = 0 UNION ALL SELECT dataset, scene_id, path_id, true, 99 - seq, x, y FROM geo WHERE (99 - seq) % 4 = 0),
dd AS (SELECT t.dataset, t.scene_id, t.track_id, p.path_id, p.invert, t.seq, min(sqrt((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y))) AS d
       FROM tp t JOIN vp p ON t.dataset = p.dataset AND t.scene_id = p.scene_id GROUP BY 1, 2, 3, 4, 5, 6),
coarse AS (SELECT dataset, scene_id, track_id, path_id, invert, avg(d) + 3e-1 * quantile_cont(d, 9e-1) AS score FROM dd GROUP BY 1, 2, 3, 4, 5)"""


@query("J5 R10", with_blocks("SELECT dataset, scene_id, track_id, path_id, invert, round(score, 4) AS coarse FROM coarse", *PATH_BLOCKS, _COARSE))
def coarse_scores(spark, d):
    v = matching.directed(routes.path_lines(mined_paths(spark, d)))
    return rounded(matching.coarse_scores(sampled(spark, d), v), ["coarse"], 4)


_PROJECT = f"""
{_resample_sql(12, 'r12')},
segs2 AS (SELECT * FROM (SELECT *, lead(x) OVER t AS nx, lead(y) OVER t AS ny FROM geo WINDOW t AS (PARTITION BY dataset, scene_id, path_id ORDER BY seq)) WHERE nx IS NOT NULL),
cross_ AS (SELECT t.dataset, t.scene_id, t.track_id, t.seq, t.x, t.y, g.path_id, g.seq AS segment, g.x AS gx, g.y AS gy, g.nx - g.x AS vx, g.ny - g.y AS vy, g.s AS gs
           FROM r12 t JOIN segs2 g ON t.dataset = g.dataset AND t.scene_id = g.scene_id),
clamped AS (SELECT *, greatest(0, least(1, ((x - gx) * vx + (y - gy) * vy) / greatest(vx * vx + vy * vy, 1e-12))) AS u FROM cross_),
hits AS (SELECT *, gs + u * sqrt(vx * vx + vy * vy) AS s, sqrt(pow(x - gx - u * vx, 2) + pow(y - gy - u * vy, 2)) AS side FROM clamped)"""


@query("R9", with_blocks(
    "SELECT dataset, scene_id, track_id, path_id, seq, round(min(side), 4) AS \"lateral\", round(min_by(s, (round(side, 7), segment)), 2) AS s FROM hits GROUP BY 1, 2, 3, 4, 5", *PATH_BLOCKS, _PROJECT))
def projections(spark, d):
    points = materialize(G.resample(lines(spark, d), KEY, 12), "points")  # small beside the tracks that it is drawn from
    paths = routes.path_lines(mined_paths(spark, d))
    out = G.projection(points.join(paths.select(*SCENE, "path_id"), SCENE), paths, [*SCENE, "path_id"])
    return out.select(*KEY, "path_id", "seq", r("lateral", 4).alias("lateral"), r("s", 2).alias("s"))


@query("R9", with_blocks("""
SELECT dataset, scene_id, track_id, path_id, seq, round(min(d), 4) AS distance, min_by(vertex, (round(d, 9), vertex)) AS vertex, round(min_by(s, (round(d, 9), vertex)), 4) AS s
FROM (SELECT t.dataset, t.scene_id, t.track_id, t.seq, g.path_id, g.seq AS vertex, g.s, sqrt(pow(t.x - g.x, 2) + pow(t.y - g.y, 2)) AS d
      FROM r12 t JOIN geo g ON t.dataset = g.dataset AND t.scene_id = g.scene_id) GROUP BY 1, 2, 3, 4, 5""", *PATH_BLOCKS, _resample_sql(12, "r12")))
def nearest_vertices(spark, d):
    points = G.resample(lines(spark, d), KEY, 12)
    paths = routes.path_lines(mined_paths(spark, d))
    joined = points.join(paths.select(*SCENE, "path_id"), SCENE)
    return rounded(G.nearest_vertex(joined, paths, [*SCENE, "path_id"]).drop("x", "y"), ["distance", "s"], 4)


# The distance fills a table along its diagonals k = i + j; a step needs the two diagonals before it.
_FRECHET = f"""
{_resample_sql(20, 'r20')},
tl AS (SELECT dataset, scene_id, track_id, list(struct_pack(x := x, y := y) ORDER BY seq) AS a FROM r20 GROUP BY 1, 2, 3),
pl AS (SELECT dataset, scene_id, path_id, list(struct_pack(x := x, y := y) ORDER BY seq) AS b FROM geo GROUP BY 1, 2, 3),
pairs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY t.dataset, t.scene_id, track_id, path_id) AS id, t.dataset, t.scene_id, track_id, path_id, a, b FROM tl t JOIN pl p ON t.dataset = p.dataset AND t.scene_id = p.scene_id),
gaps2 AS MATERIALIZED (SELECT id, i, j, sqrt(pow(a[i].x - b[j].x, 2) + pow(a[i].y - b[j].y, 2)) AS d FROM (SELECT *, unnest(range(1, 21)) AS i FROM pairs), (SELECT unnest(range(1, 101)) AS j)),
diag(id, k, i, now, last) AS (
  SELECT id, 2, i, CASE WHEN i = 1 THEN d ELSE 1e300 END, 1e300 FROM gaps2 WHERE j = 1
  UNION ALL
  SELECT w.id, w.k + 1, w.i, CASE WHEN g.d IS NULL THEN 1e300 ELSE greatest(g.d, w.best) END, w.now
  FROM (SELECT *, least(now, coalesce(lag(now) OVER t, 1e300), coalesce(lag(last) OVER t, 1e300)) AS best FROM diag WINDOW t AS (PARTITION BY id ORDER BY i)) w
  LEFT JOIN gaps2 g ON g.id = w.id AND g.i = w.i AND g.j = w.k + 1 - w.i WHERE w.k < 120)"""


@query("R12", "WITH RECURSIVE" + with_blocks("""
SELECT dataset, scene_id, track_id, path_id, round(now, 5) AS frechet FROM diag JOIN pairs USING (id) WHERE k = 120 AND i = 20""", *PATH_BLOCKS, _FRECHET)[4:])
def frechet_distances(spark, d):
    """Discrete Frechet distance of every track (20 points) to every path (all its points)."""
    t = G.to_array(G.resample(lines(spark, d), KEY, 20), KEY, "track")
    p = G.to_array(mined_paths(spark, d).select(*SCENE, "path_id", "seq", "x", "y"), [*SCENE, "path_id"])
    return t.join(p, SCENE).select(*KEY, "path_id", r(G.discrete_frechet(F.col("track"), F.col("line")), 5).alias("frechet"))


def assignments(spark, d):
    def build():
        t = lines(spark, d).withColumnRenamed("seq", "frame")
        paths = routes.path_lines(mined_paths(spark, d))
        rejects = paths.where("path_id = 'p002'").withColumnRenamed("path_id", "reject_id")
        return matching.assign(t, line_scenes(spark, d), paths.where("path_id <> 'p002'"), rejects)
    return V.landed(spark, d, "assignments", build)


# Every variant is fitted here; p002 is the reject prototype, and no scene is of the corpus with lane changes.
_VARIANT = "dataset, scene_id, track_id, path_id, invert"
_FITS = f"""
{_resample_sql(80, 't80a')},
judged AS (SELECT l.*, coalesce(total, 0) AS total FROM (SELECT dataset, scene_id, track_id, bool_and(agent_type IN ('car', 'truck', 'bus')) AS vehicle, count(*) AS n FROM lines GROUP BY 1, 2, 3) l LEFT JOIN tot USING (dataset, scene_id, track_id)),
t80 AS MATERIALIZED (SELECT t.* FROM t80a t JOIN judged j USING (dataset, scene_id, track_id) WHERE j.vehicle AND j.n >= 2 AND j.total > 1e-9),
{_chain(80, 't80', 'e80')},
heads AS (SELECT dataset, scene_id, track_id, seq, x, y, dx / greatest(sqrt(dx * dx + dy * dy), 1e-9) AS hx, dy / greatest(sqrt(dx * dx + dy * dy), 1e-9) AS hy FROM (
  SELECT *, lead(x, 1, x) OVER t - lag(x, 1, x) OVER t AS dx, lead(y, 1, y) OVER t - lag(y, 1, y) OVER t AS dy FROM t80 {_T})),
vdir AS (SELECT dataset, scene_id, path_id, false AS invert, seq, x, y, s FROM geo UNION ALL
  SELECT dataset, scene_id, path_id, true, 99 - seq, x, y, max(s) OVER (PARTITION BY dataset, scene_id, path_id) - s FROM geo),
vseg AS MATERIALIZED (SELECT *, nx - x AS vx, ny - y AS vy, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS len FROM (SELECT *, lead(x) OVER v AS nx, lead(y) OVER v AS ny FROM vdir WINDOW v AS (PARTITION BY dataset, scene_id, path_id, invert ORDER BY seq)) WHERE nx IS NOT NULL),
along AS (SELECT h.*, g.path_id, g.invert, g.seq AS segment, g.x AS gx, g.y AS gy, vx, vy, len, s AS gs, greatest(0, least(1, ((h.x - g.x) * vx + (h.y - g.y) * vy) / greatest(vx * vx + vy * vy, 1e-12))) AS u
  FROM heads h JOIN vseg g ON h.dataset = g.dataset AND h.scene_id = g.scene_id),
placed AS MATERIALIZED (SELECT {_VARIANT}, seq, sqrt(min(sq)) AS side, min_by(struct_pack(s := gs + u * len, dot := (hx * vx + hy * vy) / greatest(len, 1e-12)), segment) FILTER (sq <= least_sq * (1e0 + 1e-9) + 1e-12) AS q
  FROM (SELECT *, min(sq) OVER (PARTITION BY {_VARIANT}, seq) AS least_sq FROM (SELECT *, pow(x - gx - u * vx, 2) + pow(y - gy - u * vy, 2) AS sq FROM along)) GROUP BY {_VARIANT}, seq),
moved AS (SELECT *, q.s AS s, q.dot AS dot, q.s - lag(q.s) OVER (PARTITION BY {_VARIANT} ORDER BY seq) AS ds FROM placed),
sums AS MATERIALIZED (SELECT {_VARIANT}, avg(side) AS lateral_mean, quantile_cont(side, 9e-1) AS lateral_p90, avg(dot) AS direction, max(dot) FILTER (seq = 0) AS start_dot, max(dot) FILTER (seq = 79) AS end_dot,
    avg(CAST(ds >= -1e-6 AS DOUBLE)) AS monotonic, quantile_cont(s, 2e-2) AS lo0, quantile_cont(s, 98e-2) AS hi0, min(s) AS s0, max(s) AS s1 FROM moved GROUP BY {_VARIANT}),
span AS (SELECT *, CASE WHEN hi0 <= lo0 + 1e-9 THEN s0 ELSE lo0 END AS lo, CASE WHEN hi0 <= lo0 + 1e-9 THEN s1 ELSE hi0 END AS hi FROM sums),
wanted AS (SELECT {_VARIANT}, k AS seq, lo + (hi - lo) * k / 79e0 AS place FROM span, (SELECT unnest(range(80)) AS k)),
local AS (SELECT w.dataset, w.scene_id, w.track_id, w.path_id, w.invert, w.seq, v.x + vx * least(1, (place - s) / greatest(len, 1e-12)) AS x, v.y + vy * least(1, (place - s) / greatest(len, 1e-12)) AS y
  FROM wanted w ASOF JOIN vseg v ON w.dataset = v.dataset AND w.scene_id = v.scene_id AND w.path_id = v.path_id AND w.invert = v.invert AND w.place >= v.s),
segment AS (SELECT {_VARIANT}, avg(sqrt(pow(e.x - l.x, 2) + pow(e.y - l.y, 2))) AS segment_mean FROM local l JOIN e80 e USING (dataset, scene_id, track_id, seq) GROUP BY {_VARIANT}),
fid AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {_VARIANT}) AS id, {_VARIANT} FROM sums),
cells AS MATERIALIZED (SELECT id, e.seq // 4 + 1 AS i, l.seq // 4 + 1 AS j, sqrt(pow(e.x - l.x, 2) + pow(e.y - l.y, 2)) AS d
  FROM fid f JOIN local l USING ({_VARIANT}) JOIN e80 e ON e.dataset = f.dataset AND e.scene_id = f.scene_id AND e.track_id = f.track_id WHERE e.seq % 4 = 0 AND l.seq % 4 = 0),
fdiag(id, k, i, now, last) AS (
  SELECT id, 2, i, CASE WHEN i = 1 THEN d ELSE 1e300 END, 1e300 FROM cells WHERE j = 1
  UNION ALL
  SELECT w.id, w.k + 1, w.i, CASE WHEN g.d IS NULL THEN 1e300 ELSE greatest(g.d, w.best) END, w.now
  FROM (SELECT *, least(now, coalesce(lag(now) OVER t, 1e300), coalesce(lag(last) OVER t, 1e300)) AS best FROM fdiag WINDOW t AS (PARTITION BY id ORDER BY i)) w
  LEFT JOIN cells g ON g.id = w.id AND g.i = w.i AND g.j = w.k + 1 - w.i WHERE w.k < 40),
fits AS (SELECT {_VARIANT}, CASE WHEN hi > lo + 1e-9 THEN segment_mean END AS segment_mean, lateral_mean, lateral_p90, CASE WHEN hi > lo + 1e-9 THEN now END AS frechet, direction, start_dot, end_dot, monotonic,
    path_id = 'p002' AS reject, CASE WHEN path_id = 'p002' THEN 7e-1 ELSE 1e0 END AS scale
  FROM span JOIN segment USING ({_VARIANT}) JOIN fid USING ({_VARIANT}) JOIN fdiag USING (id) WHERE k = 40 AND i = 20),
scored AS (SELECT *, coalesce(segment_mean + lateral_p90 * 5e-1 + frechet * 25e-2 + 2e0 * greatest(0, 1 - direction) + 1e1 * greatest(0, 95e-2 - monotonic), CAST('Infinity' AS DOUBLE)) AS score,
    coalesce(segment_mean <= 6 * scale AND lateral_mean <= 35e-1 * scale AND lateral_p90 <= 8 * scale AND direction >= 35e-2 AND start_dot >= -25e-2 AND end_dot >= -25e-2 AND monotonic >= 75e-2, false) AS passed FROM fits),
ranked AS (SELECT *, row_number() OVER b AS k, lead(score) OVER b AS alt, lead(path_id) OVER b AS alt_path FROM scored WINDOW b AS (PARTITION BY dataset, scene_id, track_id, reject ORDER BY score, path_id, invert)),
best AS (SELECT *, CASE WHEN score < CAST('Infinity' AS DOUBLE) AND alt < CAST('Infinity' AS DOUBLE) THEN alt_path END AS best_alt_path_id,
    CASE WHEN score < CAST('Infinity' AS DOUBLE) AND alt < CAST('Infinity' AS DOUBLE) THEN (alt - score) / greatest(abs(score), 1e-6) END AS score_gap FROM ranked WHERE k = 1),
decided AS (SELECT * FROM best b WHERE (reject AND passed) OR (NOT reject AND NOT EXISTS (SELECT 1 FROM best o WHERE o.reject AND o.passed AND o.dataset = b.dataset AND o.scene_id = b.scene_id AND o.track_id = b.track_id))),
assigned AS MATERIALIZED (SELECT j.dataset, j.scene_id, j.track_id, CASE WHEN NOT vehicle THEN 'excluded_non_vehicle' WHEN n < 2 OR total <= 1e-9 THEN 'invalid_too_short' WHEN reject AND passed THEN 'rejected_ignore_track' WHEN passed THEN 'assigned' ELSE 'unassigned' END AS status,
    CASE WHEN passed AND NOT reject THEN path_id END AS path_id, invert, score, segment_mean, lateral_mean, lateral_p90, frechet, direction, monotonic, CASE WHEN reject THEN path_id END AS reject_id, best_alt_path_id,
    CASE WHEN NOT passed THEN path_id END AS best_candidate_path_id, CASE WHEN passed AND NOT reject THEN 'shape' END AS match_mode, score_gap, coalesce(score_gap < 1e-1, false) AS ambiguous
  FROM judged j LEFT JOIN decided d USING (dataset, scene_id, track_id))"""
# A point before a corner of a path is as near to both segments, and rounding says whose direction counts. What hangs on the
# direction is compared to fewer places: a path seen from its outer side has many such points.
_FIT_NUMBERS = {"score": 3, "segment_mean": 4, "lateral_mean": 4, "lateral_p90": 4, "frechet": 4, "direction": 3, "monotonic": 4, "score_gap": 1}
_NO_LANES = {"lane_change_count": "BIGINT", "lane_change_path_sequence": "VARCHAR"} | {f"{a}_lateral_{b}": "DOUBLE" for a in ("initial", "bundle") for b in ("mean", "p90")}


def _with_fits(body: str, *more: str) -> str:
    return "WITH RECURSIVE" + with_blocks(body, *PATH_BLOCKS, _FITS, *more)[4:]


@query("T1 R11 R13 R14 P7 P8 P9", _with_fits(
    "SELECT * EXCLUDE (" + ", ".join(_FIT_NUMBERS) + "), " + ", ".join(f"round({c}, {n}) AS {c}" for c, n in _FIT_NUMBERS.items()) + ", " + ", ".join(f"CAST(NULL AS {t}) AS {c}" for c, t in _NO_LANES.items()) + " FROM assigned"))
def assign_tracks(spark, d):
    a = assignments(spark, d).withColumn("lane_change_path_sequence", F.array_join("lane_change_path_sequence", ">"))
    return a.withColumns({c: r(c, n) for c, n in _FIT_NUMBERS.items()})


@query("R15 W10 U1")
def lane_change_matches(spark, d):
    """Tracks that drift from one route to the next, looked at as if they came from the corpus with lane changes."""
    t = lines(spark, d).withColumnRenamed("seq", "frame").withColumn("dataset", F.lit("NGSIM"))
    number = F.col("track_id").cast("long")
    t = t.withColumn("y", (number % 3) * 3.0 + F.when(F.col("frame") > 60 + number % 40, F.least(F.lit(3.0), (F.col("frame") - 60 - number % 40) * 0.1)).otherwise(0.0))
    scenes = t.select("dataset", "scene_id").distinct().withColumns({"unit": F.lit("meter"), "frame_rate": F.lit(10.0)})
    ends = t.groupBy("dataset", "scene_id").agg(F.max("x").alias("_x"))
    lanes = ends.select("dataset", "scene_id", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("_lane"), "_x")
    lanes = lanes.select("dataset", "scene_id", F.format_string("p%03d", "_lane").alias("path_id"),
                         F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.struct((F.col("_x") * i / 99.0).alias("x"), (F.col("_lane") * 3.0).cast("double").alias("y"))).alias("line"))
    sampled_, _ = matching.sampled_tracks(t, scenes)
    out = matching.lane_change_matches(sampled_, matching.directed(lanes))
    return rounded(out.withColumn("lane_change_path_sequence", F.concat_ws(">", "lane_change_path_sequence")),
                   ["score", "direction", "monotonic", "initial_lateral_mean", "initial_lateral_p90", "bundle_lateral_mean", "bundle_lateral_p90"], 4)


# One record for each track with a status from its number: the summaries with every status, also those that no match gives here.
_RECORDS = """
records AS (
  SELECT dataset, scene_id, track_id, CASE WHEN any_value(agent_type) = 'pedestrian' THEN 'excluded_non_vehicle' WHEN CAST(track_id AS BIGINT) % 6 = 0 THEN 'rejected_ignore_track'
      WHEN CAST(track_id AS BIGINT) % 6 = 1 THEN 'unassigned' WHEN count(*) < 14 THEN 'invalid_too_short' ELSE 'assigned' END AS status,
    CAST(track_id AS BIGINT) % 10 = 2 AS ambiguous, CAST(track_id AS BIGINT) % 2 = 0 AS invert,
    CASE WHEN CAST(track_id AS BIGINT) % 5 = 0 THEN 'initial_ref_path_lane_change' ELSE 'shape' END AS match_mode, max(x) AS score
  FROM tracks GROUP BY dataset, scene_id, track_id)"""
_SCENE_COUNTS = """
scene_counts AS (
  SELECT dataset, scene_id, count(*) AS n_tracks, count(*) FILTER (status = 'assigned') AS assigned, count(*) FILTER (status = 'rejected_ignore_track') AS rejected_ignore_track,
    count(*) FILTER (status = 'unassigned') AS unassigned, count(*) FILTER (status = 'excluded_non_vehicle') AS excluded_non_vehicle,
    count(*) FILTER (status = 'invalid_too_short') AS invalid_too_short, count(*) FILTER (status = 'assigned' AND ambiguous) AS ambiguous_assigned,
    count(*) FILTER (status = 'assigned' AND invert) AS inv, count(*) FILTER (status = 'assigned' AND match_mode = 'shape') AS mode_shape,
    count(*) FILTER (status = 'assigned' AND match_mode <> 'shape') AS mode_lane_change FROM records GROUP BY 1, 2),
scene_ratios AS (
  SELECT *, assigned * 1e0 / greatest(1, assigned + rejected_ignore_track + unassigned) AS assigned_ratio,
    (assigned + rejected_ignore_track) * 1e0 / greatest(1, assigned + rejected_ignore_track + unassigned) AS usable_ratio,
    ambiguous_assigned * 1e0 / greatest(1, assigned) AS ambiguous_ratio, inv * 1e0 / greatest(1, assigned) AS invert_ratio FROM scene_counts)"""
_RATIOS = ["assigned_ratio", "usable_ratio", "ambiguous_ratio", "invert_ratio"]


def status_records(spark, d):
    n = F.col("track_id").cast("long")
    t = V.tracks(spark, d).groupBy(*KEY).agg(F.first("agent_type").alias("kind"), F.count(F.lit(1)).alias("n"), F.max("x").alias("score"))
    status = F.when(F.col("kind") == "pedestrian", "excluded_non_vehicle").when(n % 6 == 0, "rejected_ignore_track").when(n % 6 == 1, "unassigned").when(
        F.col("n") < 14, "invalid_too_short").otherwise("assigned")
    mode = F.when(n % 5 == 0, "initial_ref_path_lane_change").otherwise("shape")
    return t.select(*KEY, status.alias("status"), (n % 10 == 2).alias("ambiguous"), (n % 2 == 0).alias("invert"), mode.alias("match_mode"), "score")


@query("A18", with_blocks("""
SELECT s.* EXCLUDE (inv, assigned_ratio, usable_ratio, ambiguous_ratio, invert_ratio), round(assigned_ratio, 5) AS assigned_ratio, round(usable_ratio, 5) AS usable_ratio,
  round(ambiguous_ratio, 5) AS ambiguous_ratio, round(invert_ratio, 5) AS invert_ratio, assigned_ratio < 9e-1 AS low_assigned_ratio, ambiguous_ratio > 1e-1 AS high_ambiguous_ratio,
  invert_ratio > 6e-1 AS high_invert_ratio, 9e-1 AS low_assigned_limit, 1e-1 AS high_ambiguous_limit, 6e-1 AS high_invert_limit, coalesce(p.n_paths, 0) AS n_paths
FROM scene_ratios s LEFT JOIN (SELECT dataset, scene_id, count(DISTINCT path_id) AS n_paths FROM geo GROUP BY 1, 2) p ON p.dataset = s.dataset AND p.scene_id = s.scene_id""",
    *PATH_BLOCKS, _RECORDS, _SCENE_COUNTS))
def status_summary(spark, d):
    """Counts, ratios, flags and limits per scene, with the number of paths."""
    return rounded(matching.scene_summary(status_records(spark, d), paths=mined_paths(spark, d)), _RATIOS, 5)


@query("A19 P9", with_blocks("""
SELECT coalesce(w.dataset, '(all)') AS dataset, count(s.scene_id) AS scenes, coalesce(sum(n_tracks), 0) AS tracks, coalesce(sum(assigned), 0) AS assigned,
  coalesce(sum(rejected_ignore_track), 0) AS rejected_ignore_track, coalesce(sum(unassigned), 0) AS unassigned, coalesce(sum(excluded_non_vehicle), 0) AS excluded_non_vehicle,
  coalesce(sum(invalid_too_short), 0) AS invalid_too_short, count(*) FILTER (assigned_ratio < 9e-1 OR ambiguous_ratio > 1e-1 OR invert_ratio > 6e-1) AS flagged_scenes,
  count(*) FILTER (s.scene_id IS NULL) AS missing_scenes
FROM (SELECT DISTINCT unnest(['inD', 'DJI', 'sinD']) AS dataset, scene_id FROM tracks) w
LEFT JOIN scene_ratios s ON s.dataset = w.dataset AND s.scene_id = w.scene_id GROUP BY ROLLUP (w.dataset)""", V.TRACKS_SQL, _RECORDS, _SCENE_COUNTS))
def status_batch(spark, d):
    """Totals of a batch in which every dataset was to have every scene: those without a result are counted."""
    every = F.explode(F.array(*[F.lit(x) for x in ("inD", "DJI", "sinD")])).alias("dataset")
    wanted = V.tracks(spark, d).select("scene_id").distinct().select(every, "scene_id")
    return matching.batch_summary(matching.scene_summary(status_records(spark, d)), wanted)


@query("A18 T2", with_blocks("""
SELECT dataset, scene_id, track_id, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, scene_id ORDER BY score NULLS LAST, track_id) AS i FROM records WHERE status = 'unassigned') WHERE i <= 20""", V.TRACKS_SQL, _RECORDS))
def nearest_unassigned(spark, d):
    """The unassigned tracks of each scene that came nearest to a match."""
    return rounded(matching.best_unassigned(status_records(spark, d)).select(*KEY, "score"), ["score"], 4)


_MATCHED = """
records AS (SELECT * FROM assigned)"""


@query("A18", _with_fits("""
SELECT * EXCLUDE (inv, assigned_ratio, usable_ratio, ambiguous_ratio, invert_ratio), round(assigned_ratio, 5) AS assigned_ratio, round(usable_ratio, 5) AS usable_ratio,
  round(ambiguous_ratio, 5) AS ambiguous_ratio, round(invert_ratio, 5) AS invert_ratio, assigned_ratio < 9e-1 AS low_assigned_ratio, ambiguous_ratio > 1e-1 AS high_ambiguous_ratio,
  invert_ratio > 6e-1 AS high_invert_ratio, 9e-1 AS low_assigned_limit, 1e-1 AS high_ambiguous_limit, 6e-1 AS high_invert_limit
FROM scene_ratios""", _MATCHED, _SCENE_COUNTS))
def scene_summary(spark, d):
    return rounded(matching.scene_summary(assignments(spark, d)), _RATIOS, 5)


@query("A19", _with_fits("""
SELECT coalesce(dataset, '(all)') AS dataset, count(*) AS scenes, sum(n_tracks) AS tracks, sum(assigned) AS assigned, sum(rejected_ignore_track) AS rejected_ignore_track, sum(unassigned) AS unassigned,
  sum(excluded_non_vehicle) AS excluded_non_vehicle, sum(invalid_too_short) AS invalid_too_short, count(*) FILTER (assigned_ratio < 9e-1 OR ambiguous_ratio > 1e-1 OR invert_ratio > 6e-1) AS flagged_scenes
FROM scene_ratios GROUP BY ROLLUP (dataset)""", _MATCHED, _SCENE_COUNTS))
def batch_summary(spark, d):
    return matching.batch_summary(matching.scene_summary(assignments(spark, d)))


@query("A18 T2", _with_fits("""
SELECT dataset, scene_id, track_id, best_candidate_path_id, round(score, 3) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, scene_id ORDER BY score NULLS LAST, track_id) AS i FROM assigned WHERE status = 'unassigned') WHERE i <= 20"""))
def best_unassigned(spark, d):
    out = matching.best_unassigned(assignments(spark, d))
    return rounded(out.select(*KEY, "best_candidate_path_id", "score"), ["score"], 3)


def embedding_points(spark, d):
    return V.read(spark, d, "embeddings").select(
        F.lit("embeddings").alias("dataset"), F.lit("all").alias("scene_id"), F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("vector"), "label")


_EPS = 0.9
_DBSCAN = f"""
pts AS (SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
nb AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON list_distance(a.v, b.v) <= {_EPS}e0),
deg AS (SELECT a AS id, count(*) AS n FROM nb GROUP BY 1),
core AS (SELECT id FROM deg WHERE n >= 5),
ce AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
closure AS (SELECT id AS a, id AS b FROM core UNION SELECT c.a, e.b FROM closure c JOIN ce e ON c.b = e.a),
comp AS (SELECT a AS id, min(b) AS component FROM closure GROUP BY 1),
num AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS label FROM (SELECT DISTINCT component FROM comp)),
border AS (SELECT nb.a AS id, min(component) AS component FROM nb JOIN comp ON nb.b = comp.id WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY 1)"""


@query("R2", ("WITH RECURSIVE " + _DBSCAN.strip() + """
SELECT id AS vec_id, id IN (SELECT id FROM core) AS core, coalesce(label, -1) AS cluster_id FROM pts
LEFT JOIN (SELECT * FROM comp UNION ALL SELECT * FROM border) USING (id) LEFT JOIN num USING (component)"""))
def density_clusters(spark, d):
    p = embedding_points(spark, d)
    eps = p.select("dataset", "scene_id").distinct().withColumn("eps", F.lit(_EPS))
    out = clustering.dbscan(p.drop("label"), eps, 5)
    return out.select(F.col("id").cast("long").alias("vec_id"), "core", F.col("label").cast("long").alias("cluster_id"))


@query("R2", """
WITH s AS (SELECT * FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v,
    row_number() OVER (ORDER BY CAST(concat('0x', substr(md5(lpad(CAST(vec_id AS VARCHAR), 9, '0')), 1, 15)) AS BIGINT), vec_id) AS k FROM embeddings) WHERE k <= 1000),
dist AS (SELECT list_distance(a.v, b.v) AS d FROM s a JOIN s b ON a.k <> b.k)
SELECT 'embeddings' AS dataset, 'all' AS scene_id, round(quantile_cont(d, 1e-1), 5) AS eps FROM dist WHERE d > 1e-7""")
def sampled_eps(spark, d):
    return rounded(clustering.sampled_eps(embedding_points(spark, d)), ["eps"], 5)


def route_candidates(spark, d):
    def build():
        t = lines(spark, d).withColumnRenamed("seq", "frame")
        ok = cleaning.eligible_tracks(t, line_scenes(spark, d))
        # Read by the eps, the clusters and their mean lines.
        v = materialize(routes.track_vectors(t, ok), "track-vectors")
        return routes.candidates(v, routes.cluster_tracks(v, min_samples=2))
    return V.landed(spark, d, "candidates", build)


@query("R3 A21")
def route_candidate_table(spark, d):
    c = route_candidates(spark, d)
    return rounded(c.select(*SCENE, "cluster_id", "size", "length", F.col("entry.x").alias("entry_x"), F.col("exit.y").alias("exit_y")), ["length", "entry_x", "exit_y"], 4)


@query("R4 R5 J9 P10")
def pruned_candidates(spark, d):
    sc = line_scenes(spark, d)
    keep, _ = routes.split_short_turns(route_candidates(spark, d), sc)
    kept, pruned = routes.prune_overlaps(keep, routes.overlaps(keep, sc))
    return kept.select(*SCENE, "cluster_id", F.lit("kept").alias("state"), F.lit(None).cast("int").alias("kept_cluster_id")).unionByName(
        pruned.select(*SCENE, "cluster_id", F.lit("pruned").alias("state"), "kept_cluster_id"))


# Every track as a candidate of its own: many candidates a scene, of known order and size.
_ROUTES = f"""
{_chain(100, 'r50', 'c100')}, {_chain(200, 'r50', 'c200')},
frames AS (SELECT dataset, scene_id, track_id, count(*) AS size FROM lines GROUP BY 1, 2, 3),
cand AS MATERIALIZED (
  SELECT dataset, scene_id, track_id, CAST(track_id AS BIGINT) AS cluster_id, any_value(size) AS size, sum(step_len) AS length, list(struct_pack(x := x, y := y) ORDER BY seq) AS p
  FROM c100_a JOIN frames USING (dataset, scene_id, track_id) GROUP BY 1, 2, 3),
facing AS (SELECT dataset, scene_id, cluster_id, track_id, size, length, p[6].x - p[1].x AS sx, p[6].y - p[1].y AS sy, p[50].x - p[45].x AS ex, p[50].y - p[45].y AS ey FROM cand WHERE length > 1e-9 AND dataset <> 'CitySim'),
met AS MATERIALIZED (
  SELECT * FROM (
    SELECT a.dataset, a.scene_id, a.cluster_id, b.cluster_id AS earlier_id, a.track_id, b.track_id AS earlier_track, b.length AS earlier_length, b.size AS earlier_size, a.length / b.length AS length_ratio,
           (a.sx * b.sx + a.sy * b.sy) / greatest(sqrt(a.sx * a.sx + a.sy * a.sy) * sqrt(b.sx * b.sx + b.sy * b.sy), 1e-9) AS start_dot,
           (a.ex * b.ex + a.ey * b.ey) / greatest(sqrt(a.ex * a.ex + a.ey * a.ey) * sqrt(b.ex * b.ex + b.ey * b.ey), 1e-9) AS end_dot
    FROM facing a JOIN facing b ON a.dataset = b.dataset AND a.scene_id = b.scene_id AND (-b.length, -b.size, b.cluster_id) < (-a.length, -a.size, a.cluster_id))
  WHERE length_ratio >= 55e-2 AND least(start_dot, end_dot) >= 85e-2),
nearest AS (
  SELECT m.dataset, m.scene_id, m.cluster_id, m.earlier_id, c.seq, min(sqrt((c.x - e.x) * (c.x - e.x) + (c.y - e.y) * (c.y - e.y))) AS d
  FROM met m JOIN c100 c ON c.dataset = m.dataset AND c.scene_id = m.scene_id AND c.track_id = m.track_id JOIN c200 e ON e.dataset = m.dataset AND e.scene_id = m.scene_id AND e.track_id = m.earlier_track
  GROUP BY 1, 2, 3, 4, 5),
edges AS MATERIALIZED (
  SELECT * FROM met JOIN (SELECT dataset, scene_id, cluster_id, earlier_id, avg(d) AS mean_nearest, quantile_cont(d, 9e-1) AS p90_nearest FROM nearest GROUP BY 1, 2, 3, 4) USING (dataset, scene_id, cluster_id, earlier_id)
  WHERE mean_nearest <= 16e-1 AND p90_nearest <= 3e0)"""
_ROUTE_BLOCKS = [V.TRACKS_SQL, LINES_SQL, _ARC, _resample_sql(50, "r50"), _ROUTES]

# One candidate of a scene after the other: kept unless it overlaps one that is kept already.
_KEPT = """
turn AS MATERIALIZED (
  SELECT c.*, row_number() OVER (PARTITION BY dataset, scene_id ORDER BY -length, -size, cluster_id) AS k, coalesce(earlier, []) AS earlier
  FROM (SELECT dataset, scene_id, cluster_id, size, length FROM cand) c LEFT JOIN (SELECT dataset, scene_id, cluster_id, list(earlier_id) AS earlier FROM edges GROUP BY 1, 2, 3) USING (dataset, scene_id, cluster_id)),
greedy(dataset, scene_id, k, kept) AS (
  SELECT DISTINCT dataset, scene_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM turn
  UNION ALL
  SELECT g.dataset, g.scene_id, t.k, CASE WHEN list_has_any(g.kept, t.earlier) THEN g.kept ELSE list_append(g.kept, t.cluster_id) END
  FROM greedy g JOIN turn t ON t.dataset = g.dataset AND t.scene_id = g.scene_id AND t.k = g.k + 1),
kept AS (SELECT dataset, scene_id, unnest(max_by(kept, k)) AS cluster_id FROM greedy GROUP BY 1, 2),
covered AS (
  SELECT e.dataset, e.scene_id, e.cluster_id, min_by(struct_pack(earlier_id, length_ratio, mean_nearest, p90_nearest), (-earlier_length, -earlier_size, earlier_id)) AS o
  FROM edges e JOIN kept k ON k.dataset = e.dataset AND k.scene_id = e.scene_id AND k.cluster_id = e.earlier_id GROUP BY 1, 2, 3)"""


def track_routes(spark, d):
    def build():
        t = lines(spark, d)
        line = G.to_array(G.resample(t, KEY, 50), KEY).join(t.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size")), KEY)
        return line.select(*SCENE, F.col("track_id").cast("int").alias("cluster_id"), "line", "size", G.line_length(F.col("line")).alias("length"))
    return V.landed(spark, d, "track-routes", build)


@query("J9", with_blocks("""
SELECT dataset, scene_id, cluster_id, earlier_id, round(length_ratio, 4) AS length_ratio, round(start_dot, 4) + 0e0 AS start_dot, round(end_dot, 4) + 0e0 AS end_dot,
       round(mean_nearest, 4) AS mean_nearest, round(p90_nearest, 4) AS p90_nearest FROM edges""", *_ROUTE_BLOCKS))
def overlapping_routes(spark, d):
    out = routes.overlaps(track_routes(spark, d), line_scenes(spark, d)).drop("earlier_length", "earlier_size")
    return rounded(out, ["length_ratio", "start_dot", "end_dot", "mean_nearest", "p90_nearest"], 4)


@query("R5 P10", "WITH RECURSIVE" + with_blocks("""
SELECT dataset, scene_id, cluster_id, 'kept' AS state, CAST(NULL AS BIGINT) AS kept_cluster_id, CAST(NULL AS DOUBLE) AS length_ratio, CAST(NULL AS DOUBLE) AS mean_nearest, CAST(NULL AS DOUBLE) AS p90_nearest FROM kept
UNION ALL
SELECT dataset, scene_id, cluster_id, 'pruned', o.earlier_id, round(o.length_ratio, 4), round(o.mean_nearest, 4), round(o.p90_nearest, 4) FROM covered""", *_ROUTE_BLOCKS, _KEPT)[4:])
def pruned_routes(spark, d):
    c = track_routes(spark, d)
    kept, pruned = routes.prune_overlaps(c, routes.overlaps(c, line_scenes(spark, d)))
    figures = ["length_ratio", "mean_nearest", "p90_nearest"]
    kept = kept.select(*SCENE, "cluster_id", F.lit("kept").alias("state"), F.lit(None).cast("int").alias("kept_cluster_id"), *[F.lit(None).cast("double").alias(f) for f in figures])
    return kept.unionByName(rounded(pruned.select(*SCENE, "cluster_id", F.lit("pruned").alias("state"), "kept_cluster_id", *figures), figures, 4))


@query("R7 U3")
def manual_selection(spark, d):
    c = route_candidates(spark, d)
    k = F.col("cluster_id") % 3
    decisions = c.select(*SCENE, "cluster_id", F.when(k == 0, "accepted").when(k == 1, "rejected").otherwise("deleted").alias("decision"))
    accepted, rejects = routes.manual_selection(c, decisions)
    return accepted.select(*SCENE, "cluster_id", F.lit("accepted").alias("decision"), F.lit(None).cast("string").alias("reject_id")).unionByName(
        rejects.select(*SCENE, "cluster_id", F.lit("rejected").alias("decision"), "reject_id"))
