"""Queries over cleaning, neighbours, windows and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom import constants as K
from trackloom.functions import columns as C
from trackloom.operators import bounded, cleaning, neighbors, slices, transitions
from trackloom.plans import views as V
from trackloom.plans.registry import query, r, rounded, with_blocks

TRACK = ["dataset", "scene_id", "recording", "track_id"]
KEY = ["dataset", "scene_id", "track_id"]

_HOLES = """
holes AS (SELECT *, CASE WHEN event_id % 53 = 0 THEN CAST('NaN' AS DOUBLE)
                         WHEN event_id % 59 = 0 THEN CAST('Infinity' AS DOUBLE)
                         WHEN event_id % 61 = 0 THEN NULL ELSE vx END AS vh FROM tracks)"""


@query("F1", with_blocks(
    "SELECT dataset, scene_id, count(*) AS n, round(sum(vh), 4) AS total FROM holes "
    "WHERE vh IS NOT NULL AND NOT isnan(vh) AND NOT isinf(vh) GROUP BY 1, 2", V.TRACKS_SQL, _HOLES))
def finite_rows(spark, d):
    t = V.tracks(spark, d)
    vh = F.expr("CASE WHEN event_id % 53 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 59 = 0 THEN "
                "CAST('Infinity' AS DOUBLE) WHEN event_id % 61 = 0 THEN NULL ELSE vx END")
    rows = cleaning.finite_rows(t.withColumn("vh", vh), ["vh", "x", "agent_type"], skip={"agent_type"})
    return rows.groupBy("dataset", "scene_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("vh"), 4).alias("total"))


@query("F2 P4", with_blocks(
    "SELECT scene_id, kind, count(*) AS n, count(DISTINCT track_id) AS n_tracks FROM ("
    "SELECT *, CASE WHEN event_id % 2 = 0 THEN upper(agent_type) ELSE agent_type END AS kind FROM tracks) "
    "WHERE lower(kind) IN ('car', 'bus') GROUP BY 1, 2", V.TRACKS_SQL))
def vehicle_classes(spark, d):
    t = V.tracks(spark, d).withColumn(
        "kind", F.when(F.col("event_id") % 2 == 0, F.upper("agent_type")).otherwise(F.col("agent_type")))
    rows = cleaning.vehicle_rows(t, ["car", "bus"], "kind", fold_case=True)
    per_track = rows.groupBy("scene_id", "kind", "track_id").agg(F.count(F.lit(1)).alias("n"))
    return per_track.groupBy("scene_id", "kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_tracks"))


@query("F3 U2 S12 P3", with_blocks(
    "SELECT dataset, scene_id, track_id, count(*) AS n FROM tracks WHERE is_assigned AND agent_type IN ('car','truck','bus') "
    "GROUP BY 1, 2, 3", V.TRACKS_SQL))
def assigned_vehicles(spark, d):
    t = V.tracks(spark, d)
    assigned = t.where("is_assigned").select(*KEY).distinct()
    vehicle = cleaning.vehicle_rows(t, V.VEHICLES).select(*KEY).distinct()
    rows = cleaning.assigned_rows(t, assigned.intersect(vehicle))
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


_SCENE_BOX = """
box AS (SELECT dataset, scene_id, quantile_cont(x, 1e-2) AS x_lo, quantile_cont(x, 99e-2) AS x_hi,
               quantile_cont(y, 1e-2) AS y_lo, quantile_cont(y, 99e-2) AS y_hi FROM tracks GROUP BY 1, 2),
boxed AS (SELECT *, sqrt((x_hi - x_lo) * (x_hi - x_lo) + (y_hi - y_lo) * (y_hi - y_lo)) AS diagonal FROM box)"""


@query("A20", with_blocks(
    "SELECT dataset, scene_id, round(x_lo, 6) AS x_lo, round(x_hi, 6) AS x_hi, round(y_lo, 6) AS y_lo, "
    "round(y_hi, 6) AS y_hi, round(diagonal, 6) AS diagonal FROM boxed", V.TRACKS_SQL, _SCENE_BOX))
def scene_box(spark, d):
    return rounded(cleaning.scene_box(V.tracks(spark, d)), ["x_lo", "x_hi", "y_lo", "y_hi", "diagonal"])


@query("F4 F5", with_blocks("""
SELECT s.dataset, s.scene_id, s.track_id, s.n_points FROM (
  SELECT dataset, scene_id, track_id, count(*) AS n_points, min_by(x, frame) AS x0, min_by(y, frame) AS y0,
         max_by(x, frame) AS x1, max_by(y, frame) AS y1, min(agent_type) AS kind,
         max(CASE dataset WHEN 'inD' THEN 25e0 WHEN 'DJI' THEN 30e0 ELSE 10e0 END) AS rate
  FROM tracks GROUP BY 1, 2, 3) s JOIN boxed USING (dataset, scene_id)
WHERE kind IN ('car', 'truck', 'bus') AND n_points >= greatest(2, round_even(rate * 3e0, 0))
  AND (x0 <= x_lo + (x_hi - x_lo) * 8e-2 OR x0 >= x_hi - (x_hi - x_lo) * 8e-2 OR y0 <= y_lo + (y_hi - y_lo) * 8e-2 OR y0 >= y_hi - (y_hi - y_lo) * 8e-2)
  AND (x1 <= x_lo + (x_hi - x_lo) * 8e-2 OR x1 >= x_hi - (x_hi - x_lo) * 8e-2 OR y1 <= y_lo + (y_hi - y_lo) * 8e-2 OR y1 >= y_hi - (y_hi - y_lo) * 8e-2)
  AND sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) > diagonal * 15e-2""", V.TRACKS_SQL, _SCENE_BOX))
def eligible_tracks(spark, d):
    t = V.tracks(spark, d)
    return cleaning.eligible_tracks(t, V.scenes(t), require_boundary=True)


@query("F6", with_blocks(
    "SELECT dataset, scene_id, count(*) AS n FROM tracks WHERE track_id IN "
    "(SELECT track_id FROM tracks GROUP BY 1 HAVING count(*) >= 190) GROUP BY 1, 2", V.TRACKS_SQL))
def minimum_length(spark, d):
    rows = cleaning.long_enough(V.tracks(spark, d), 190, TRACK)
    return rows.groupBy("dataset", "scene_id").agg(F.count(F.lit(1)).alias("n"))


_SECTOR_OUT = ("SELECT dataset, scene_id, recording, track_id, frame, " + ", ".join(
    f"round(d{i}, 6) AS dist_{n}" for i, n in enumerate(K.SECTORS)) + " FROM sectors")
_SECTOR_COLS = [f"dist_{n}" for n in K.SECTORS]


@query("J2 A1 H4", with_blocks(_SECTOR_OUT, *V.BASE, V.PAIRS_SQL, V.HEADING_SQL, V.SECTORS_SQL))
def sector_neighbors(spark, d):
    return rounded(V.sectors(spark, d).drop("vx", "vy", "ax", "ay"), _SECTOR_COLS)


@query("J4", with_blocks(_SECTOR_OUT, *V.BASE, V.PAIRS_SQL, V.LANE_SQL, V.SECTORS_SQL))
def lane_neighbors(spark, d):
    out = neighbors.sector_distances(
        V.vehicles(spark, d), V.RADIUS, "lane", half_length=F.greatest(F.col("length") * 0.5, F.lit(1.5)))
    return rounded(out.drop("lane_id"), _SECTOR_COLS)


_ID_SLOTS = " UNION ALL ".join(
    f"SELECT recording, track_id, frame, x, y, {i} AS s, CASE WHEN (CAST(track_id AS BIGINT) + {i}) % 5 = 0 THEN '0' "
    f"ELSE CAST(CAST(track_id AS BIGINT) + {i + 1} AS VARCHAR) END AS other FROM veh" for i in range(8))


@query("J3", with_blocks(
    _SECTOR_OUT, *V.BASE, f"slots AS ({_ID_SLOTS})",
    "coded AS (SELECT a.recording, a.track_id, a.frame, a.s, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d "
    "FROM slots a JOIN veh b ON a.recording = b.recording AND a.frame = b.frame AND a.other = b.track_id)", V.SECTORS_SQL))
def id_neighbors(spark, d):
    rows = V.vehicles(spark, d)
    tid = F.col("track_id").cast("long")
    for i, name in enumerate(K.NEIGHBOR_ID_COLUMNS):
        rows = rows.withColumn(name, F.when((tid + i) % 5 == 0, 0).otherwise(tid + i + 1))
    return rounded(neighbors.neighbor_id_distances(rows), _SECTOR_COLS)


_F = "round(CAST({} AS DOUBLE), 5)"
_WINDOW_OUT = (
    "SELECT dataset, scene_id, track_id, frame_k, frame_next, kept, "
    + ", ".join(f"{_F.format(f'state[12][{i + 1}]')} AS last_{i}" for i in range(12))
    + f", {_F.format('state[1][1]')} AS first_vx, {_F.format('next_state[12][5]')} AS next_gap"
    + ", round(list_sum(list_transform(state, lambda f: CAST(f[5] AS DOUBLE))), 4) AS gap_sum"
    + f", {_F.format('action[1]')} AS ax, {_F.format('next_action[2]')} AS next_ay FROM windows")


@query("W1 F7 F8 P1 J12", with_blocks(_WINDOW_OUT, *V.WINDOW_BLOCKS))
def transition_windows(spark, d):
    w = V.windows(spark, d)
    f = lambda c: r(c.cast("double"), 5)
    last = F.element_at("state", -1)
    return w.select(
        *KEY, "frame_k", "frame_next", "kept", *[f(last[i]).alias(f"last_{i}") for i in range(12)],
        f(F.col("state")[0][0]).alias("first_vx"), f(F.element_at("next_state", -1)[4]).alias("next_gap"),
        r(F.aggregate("state", F.lit(0.0), lambda s, x: s + x[4].cast("double")), 4).alias("gap_sum"),
        f(F.col("action")[0]).alias("ax"), f(F.col("next_action")[1]).alias("next_ay"))


_SUMMARY = """
cand AS (SELECT dataset, scene_id, sum(CASE WHEN n >= 14 THEN CAST(ceil((n - 13) / 12e0) AS BIGINT) ELSE 0 END) AS candidates
         FROM (SELECT dataset, scene_id, track_id, count(*) AS n FROM veh GROUP BY 1, 2, 3) GROUP BY 1, 2),
judged AS (SELECT dataset, scene_id, count(*) AS consecutive, count(*) FILTER (kept) AS kept,
                  count(*) FILTER (kept AND split = 'train') AS train, count(*) FILTER (kept AND split = 'val') AS val,
                  count(*) FILTER (kept AND split = 'test') AS test FROM split_windows GROUP BY 1, 2)"""
_SUMMARY_OUT = """
SELECT coalesce(dataset, '(all)') AS dataset, coalesce(scene_id, '(all)') AS scene_id,
       CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(coalesce(kept, 0)) AS BIGINT) AS kept,
       CAST(sum(coalesce(train, 0)) AS BIGINT) AS train, CAST(sum(coalesce(val, 0)) AS BIGINT) AS val,
       CAST(sum(coalesce(test, 0)) AS BIGINT) AS test,
       CAST(sum(candidates) - sum(coalesce(consecutive, 0)) AS BIGINT) AS skipped_nonconsecutive,
       CAST(sum(coalesce(consecutive, 0)) - sum(coalesce(kept, 0)) AS BIGINT) AS skipped_physical
FROM cand LEFT JOIN judged USING (dataset, scene_id) GROUP BY ROLLUP (dataset, scene_id)"""


def summarize_build(spark, d):
    """The whole path from tracks to split counts, without the landed windows."""
    return transitions.build_summary(
        transitions.window_counts(V.vehicles(spark, d)), V.derive_windows(spark, d))


@query("A2 P2 H1", with_blocks(_SUMMARY_OUT, *V.WINDOW_BLOCKS, _SUMMARY))
def build_transitions(spark, d):
    return summarize_build(spark, d)


@query("H1")
def blake2b_splits(spark, d):
    """Split counts by the published hash (SQL has no blake2b, so no oracle)."""
    w = V.kept_windows(spark, d).drop("split")
    return transitions.with_split(w).groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n"))


@query("H3", with_blocks("""
SELECT file_stem, split, count(*) AS n_tracks FROM (
  SELECT file_stem, CASE WHEN file_split = 'train' THEN 'train' WHEN unit < 5e-1 THEN 'test' ELSE 'val' END AS split FROM (
    SELECT DISTINCT file_stem, file_split, case_id, track_number,
      CAST(concat('0x', substr(md5(concat('INTERACTION/CHN/', file_stem, '/', case_id, '/', track_number)), 1, 8)) AS BIGINT) / 4294967296e0 AS unit
    FROM (SELECT concat('DR_CHN_', scene_id, '_', CASE WHEN lane_id % 2 = 0 THEN 'train' ELSE 'val' END) AS file_stem,
                 CASE WHEN lane_id % 2 = 0 THEN 'train' ELSE 'val' END AS file_split,
                 CAST(floor(frame / 5e1) AS BIGINT) AS case_id, CAST(track_id AS BIGINT) AS track_number FROM tracks))) GROUP BY 1, 2""", V.TRACKS_SQL))
def file_splits(spark, d):
    side = F.when(F.col("lane_id") % 2 == 0, "train").otherwise("val")
    t = V.tracks(spark, d).select(
        F.lit("CHN").alias("country"), F.concat(F.lit("DR_CHN_"), "scene_id", F.lit("_"), side).alias("file_stem"),
        side.alias("file_split"), F.floor(F.col("frame") / 50.0).cast("long").alias("case_id"),
        F.col("track_id").cast("long").alias("track_number"))
    return transitions.file_splits(t, 0.5, "md5").groupBy("file_stem", "split").agg(F.count(F.lit(1)).alias("n_tracks"))


@query("F9", with_blocks("""
SELECT dataset, scene_id, track_id, frame_k FROM windows
WHERE len(list_filter(state, lambda f: sqrt(CAST(f[1] AS DOUBLE) * f[1] + CAST(f[3] AS DOUBLE) * f[3]) < 25e-1)) > 6""", *V.WINDOW_BLOCKS))
def mostly_still(spark, d):
    w = V.windows(spark, d)
    return w.where(transitions.mostly_still(F.col("state"), 2.5)).select(*KEY, "frame_k")


@query("F10", with_blocks(
    "SELECT dataset, scene_id, track_id, frame_k FROM kept ORDER BY dataset, scene_id, track_id, frame_k LIMIT 100", *V.WINDOW_BLOCKS))
def sample_cap(spark, d):
    return cleaning.first_rows(V.kept_windows(spark, d).select(*KEY, "frame_k"), [*KEY, "frame_k"], 100)


@query("F11", with_blocks("""
SELECT dataset, scene_id, track_id, frame_k, round(speed, 5) AS speed FROM (
  SELECT *, quantile_cont(speed, 9e-1) OVER () AS cut FROM (
    SELECT *, sqrt(CAST(state[12][1] AS DOUBLE) * state[12][1] + CAST(state[12][3] AS DOUBLE) * state[12][3]) AS speed FROM kept))
WHERE speed >= cut""", *V.WINDOW_BLOCKS))
def fastest_tenth(spark, d):
    w = slices.with_slice_features(V.kept_windows(spark, d))
    return slices.subset(w, "high_speed_top", top=0.1).select(*KEY, "frame_k", r("speed", 5).alias("speed"))


@query("F12", "SELECT DISTINCT regexp_replace(concat(c_name, ' / ', c_mktsegment), '[^\\p{L}\\p{N}_-]', '_', 'g') AS safe_id FROM customer")
def safe_identifiers(spark, d):
    name = F.concat_ws(" / ", "c_name", "c_mktsegment")
    return V.read(spark, d, "customer").select(C.safe_identifier(name).alias("safe_id")).distinct()


_WANTED = """
wanted AS (SELECT CAST(CAST(floor(o_custkey / 1e1) AS BIGINT) AS VARCHAR) AS track_id, min(o_orderkey) AS position FROM orders GROUP BY 1)"""


@query("F13 U3", with_blocks("""
SELECT w.track_id, w.position, coalesce(t.n, 0) AS n_rows, t.n IS NOT NULL AS found FROM wanted w
LEFT JOIN (SELECT track_id, count(*) AS n FROM tracks GROUP BY 1) t USING (track_id)""", V.TRACKS_SQL, _WANTED))
def requested_cases(spark, d):
    sizes = V.tracks(spark, d).groupBy("track_id").agg(F.count(F.lit(1)).alias("n_rows"))
    wanted = V.read(spark, d, "orders").select(
        F.floor(F.col("o_custkey") / 10.0).cast("long").cast("string").alias("track_id"), F.col("o_orderkey").alias("position"))
    found, missing = cleaning.requested(sizes, wanted, "track_id")
    return found.select("track_id", "position", "n_rows", F.lit(True).alias("found")).unionByName(
        missing.select("track_id", "position", F.lit(0).cast("long").alias("n_rows"), F.lit(False).alias("found")))


@query("J1 S1", with_blocks("""
SELECT t.dataset, t.track_id, coalesce(m.c_mktsegment, 'vehicle') AS class, m.c_custkey IS NOT NULL AS has_meta, count(*) AS n
FROM tracks t LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) m ON CAST(t.track_id AS BIGINT) = m.c_custkey
GROUP BY 1, 2, 3, 4""", V.TRACKS_SQL))
def meta_lookup(spark, d):
    from trackloom.sources.corpora import with_meta

    meta = V.read(spark, d, "customer").where("c_custkey % 3 <> 0").select(
        F.col("c_custkey").cast("string").alias("track_id"), F.col("c_mktsegment").alias("class"), F.lit(True).alias("has_meta"))
    out = with_meta(V.tracks(spark, d).drop("agent_type"), meta, ["track_id"])
    return out.groupBy("dataset", "track_id", F.col("agent_type").alias("class"), F.coalesce("has_meta", F.lit(False)).alias("has_meta")).agg(
        F.count(F.lit(1)).alias("n"))


_STATS_PARTS = " UNION ALL ".join(
    f"SELECT 'state_{i:02d}' AS name, avg(CAST(f[{i + 1}] AS DOUBLE)) AS m, stddev_pop(CAST(f[{i + 1}] AS DOUBLE)) AS s FROM rows_" for i in range(12))
_STATS_PARTS += " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'action_{i}' AS name, avg(CAST(action[{i + 1}] AS DOUBLE)), stddev_pop(CAST(action[{i + 1}] AS DOUBLE)) FROM kept" for i in range(2))
_STATS = f"""
rows_ AS (SELECT unnest(state) AS f FROM kept),
stats AS (SELECT name, m, CASE WHEN s < 1e-6 THEN 1e0 ELSE s END AS s FROM ({_STATS_PARTS}))"""


@query("A3", with_blocks("SELECT name, round(m, 5) AS mean, round(s, 5) AS std FROM stats", *V.WINDOW_BLOCKS, _STATS))
def normalization_stats(spark, d):
    st = transitions.norm_stats(V.kept_windows(spark, d))
    parts = [F.struct(F.lit(f"state_{i:02d}").alias("name"), F.col("state_mean")[i].alias("mean"), F.col("state_std")[i].alias("std")) for i in range(12)]
    parts += [F.struct(F.lit(f"action_{i}").alias("name"), F.col("action_mean")[i].alias("mean"), F.col("action_std")[i].alias("std")) for i in range(2)]
    return rounded(st.select(F.inline(F.array(*parts))), ["mean", "std"], 5)


@query("H10", with_blocks("""
SELECT dataset, scene_id, track_id, frame_k,
  round((CAST(state[12][1] AS DOUBLE) - (SELECT m FROM stats WHERE name = 'state_00')) / (SELECT s FROM stats WHERE name = 'state_00'), 5) AS last_vx_norm,
  round((CAST(action[2] AS DOUBLE) - (SELECT m FROM stats WHERE name = 'action_1')) / (SELECT s FROM stats WHERE name = 'action_1'), 5) AS ay_norm,
  round(CAST(action[1] AS DOUBLE), 5) AS ax_back
FROM kept""", *V.WINDOW_BLOCKS, _STATS))
def normalized_windows(spark, d):
    w = V.kept_windows(spark, d)
    st = transitions.norm_stats(w)
    n = transitions.normalized(w, st).crossJoin(F.broadcast(st))  # one row
    back = C.destandardize(F.col("action_norm"), F.col("action_mean"), F.col("action_std"))
    return n.select(*KEY, "frame_k", r(F.element_at("state_norm", -1)[0], 5).alias("last_vx_norm"),
                    r(F.col("action_norm")[1], 5).alias("ay_norm"), r(back[0], 5).alias("ax_back"))


@query("T6 H2 A23 P14", with_blocks("""
SELECT dataset, split, count(*) AS rows_seen, count(DISTINCT concat(scene_id, '/', track_id)) AS tracks_seen,
       count(*) FILTER (unit < 5e-1) AS rows_kept,
       count(DISTINCT concat(scene_id, '/', track_id)) FILTER (unit < 5e-1) AS tracks_kept
FROM split_windows WHERE kept GROUP BY 1, 2""", *V.WINDOW_BLOCKS))
def fraction_sample(spark, d):
    w = V.kept_windows(spark, d)
    kept = transitions.fraction_of_tracks(w, 0.5, "md5")
    return transitions.seen_and_kept(w, kept, ["dataset", "split"])


@query("H2")
def blake2b_fraction(spark, d):
    w = V.kept_windows(spark, d)
    return transitions.seen_and_kept(w, transitions.fraction_of_tracks(w, 0.5), ["dataset"])


@query("W2 W3", with_blocks("""
SELECT dataset, recording, track_id, count(*) AS n, min(frame) AS first_frame, round(sum(speed), 4) AS total FROM (
  SELECT *, max(CASE WHEN abs(speed) > 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY recording, track_id ORDER BY frame) AS moved FROM (
    SELECT * FROM (
      SELECT dataset, recording, track_id, CAST(floor(frame / 2e0) AS BIGINT) AS frame, event_id,
             CASE WHEN frame < 6 + CAST(track_id AS BIGINT) % 5 THEN 0e0 ELSE vx END AS speed,
             row_number() OVER (PARTITION BY recording, track_id, CAST(floor(frame / 2e0) AS BIGINT) ORDER BY event_id) AS k FROM tracks)
    WHERE k = 1))
WHERE moved = 1 GROUP BY 1, 2, 3""", V.TRACKS_SQL))
def first_motion(spark, d):
    t = V.tracks(spark, d).select(
        "dataset", "recording", "track_id", F.floor(F.col("frame") / 2.0).cast("long").alias("frame"), "event_id",
        F.when(F.col("frame") < 6 + F.col("track_id").cast("long") % 5, 0.0).otherwise(F.col("vx")).alias("speed"))
    rows = cleaning.from_first_motion(cleaning.first_per_frame(t, "event_id"))
    return rows.groupBy("dataset", "recording", "track_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame").alias("first_frame"), r(F.sum("speed"), 4).alias("total"))


@query("W4 T5", with_blocks("""
SELECT dataset, recording, track_id, frame, lifetime FROM (
  SELECT *, row_number() OVER (PARTITION BY recording, track_id ORDER BY frame) - 1 AS lifetime FROM tracks) WHERE lifetime < 20""", V.TRACKS_SQL))
def head_of_tracks(spark, d):
    t = V.tracks(spark, d).select("dataset", "recording", "track_id", "frame")
    head = cleaning.head_per_source(t, ["dataset", "recording", "track_id"], ["frame"], 20)
    return bounded.positions(head, ["dataset", "recording", "track_id"], ["frame"], name="lifetime")


@query("T4", with_blocks("""
SELECT dataset, scene_id, track_id, frame_k FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY h, scene_id, track_id, frame_k) AS k FROM (
    SELECT *, CAST(concat('0x', substr(md5(concat_ws('/', dataset, scene_id, track_id, CAST(frame_k AS VARCHAR), '42')), 1, 15)) AS BIGINT) AS h FROM kept))
WHERE k <= 50""", *V.WINDOW_BLOCKS))
def seeded_sample(spark, d):
    w = V.kept_windows(spark, d).select(*KEY, "frame_k")
    return cleaning.seeded_sample(w, [*KEY, "frame_k"], 50, within=["dataset"])


@query("P25", "SELECT props, CAST(user_id AS BIGINT) AS ego_id, count(*) AS n FROM events WHERE event_id % 4 <> 0 GROUP BY 1, 2")
def integer_ids(spark, d):
    e = V.read(spark, d, "events").withColumn(
        "ego_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("v"), F.col("user_id"))).otherwise(F.col("user_id").cast("string")))
    return cleaning.normalized_ids(e, "ego_id").groupBy("props", "ego_id").agg(F.count(F.lit(1)).alias("n"))


_DEMO = """
cutrange AS (SELECT * FROM veh WHERE frame BETWEEN 40 AND 120),
long_ AS (SELECT * FROM cutrange WHERE track_id IN (SELECT track_id FROM cutrange GROUP BY 1 HAVING count(*) >= 75))"""


@query("S18 P26 P27", with_blocks("""
SELECT m.recording, m.track_id, m."initialFrame", m."finalFrame", m."numFrames", m.max_lifetime,
       count(*) OVER (PARTITION BY m.recording) AS "numTracks",
       81e0 / 25e0 AS duration
FROM (SELECT recording, track_id, min(frame) AS "initialFrame", max(frame) AS "finalFrame", count(*) AS "numFrames",
             count(*) - 1 AS max_lifetime FROM long_ GROUP BY 1, 2) m""", *V.BASE, _DEMO))
def demo_subset(spark, d):
    t = V.tracks(spark, d)
    meta = t.select("recording", "track_id", F.col("agent_type").alias("class")).distinct()
    rec = t.select("recording").distinct().withColumn("frameRate", F.lit(25.0))
    rows, track_meta, rec_meta = cleaning.demo_subset(
        t, meta, rec, t.where("is_assigned").select("recording", "track_id").distinct(), 40, 120, V.VEHICLES, 75)
    life = rows.groupBy("recording", "track_id").agg(F.max("track_lifetime").alias("max_lifetime"))
    return track_meta.drop("class").join(life, ["recording", "track_id"]).join(
        rec_meta.select("recording", "numTracks", "duration"), "recording")
