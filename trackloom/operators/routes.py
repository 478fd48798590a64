"""Route mining: vectors, clusters, candidates, pruning, manual selection, final paths, quality report."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from trackloom.functions.lines import points_of
from trackloom.operators import bounded, clustering, geometry as G
from trackloom.session import discard, materialize

SCENE = ["dataset", "scene_id"]
POINTS = 50
CLUSTER = ["dataset", "scene_id", "cluster_id"]


def track_vectors(tracks: DataFrame, eligible: DataFrame, n: int = POINTS, shape_only: bool = False) -> DataFrame:
    """Resampled tracks as rows plus one flat vector x0, y0, x1, y1, ... per track."""
    keys = [*SCENE, "track_id"]
    rows = tracks.join(eligible.select(*keys), keys, "left_semi").select(*keys, "frame", "x", "y")
    line = G.to_array(G.resample(rows, keys, n, "frame"), keys)
    if shape_only:
        cx, cy = (G.array_mean(F.transform("line", lambda p: p[c])) for c in "xy")
        line = line.withColumns({"_cx": cx, "_cy": cy})
        norm = F.sqrt(F.aggregate("line", F.lit(0.0), lambda s, p: s + F.pow(p["x"] - F.col("_cx"), 2) + F.pow(p["y"] - F.col("_cy"), 2)))
        line = line.withColumn("_n", F.greatest(norm, F.lit(1e-9)))
        flat = F.transform("line", lambda p: F.array((p["x"] - F.col("_cx")) / F.col("_n"), (p["y"] - F.col("_cy")) / F.col("_n")))
    else:
        flat = F.transform("line", lambda p: F.array(p["x"], p["y"]))
    return line.select(*keys, "line", F.flatten(flat).alias("vector"))


def cluster_tracks(vectors: DataFrame, min_samples: int = 5, sample: int = clustering.SAMPLE) -> DataFrame:
    """Density clusters of track vectors."""
    points = vectors.select(*SCENE, F.col("track_id").alias("id"), "vector")
    labels = clustering.dbscan(points, clustering.sampled_eps(points, sample=sample), min_samples)
    return labels.select(*SCENE, F.col("id").alias("track_id"), F.col("label").alias("cluster_id"))


def candidates(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean line and size of every cluster. Members stay a table of their own (``labels``)."""
    keys = [*SCENE, "track_id"]
    rows = vectors.join(labels.where(F.col("cluster_id") >= 0), keys).select(*CLUSTER, F.posexplode("line").alias("seq", "p"))
    mean = rows.groupBy(*CLUSTER, "seq").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"), F.count(F.lit(1)).alias("size"))
    size = mean.where(F.col("seq") == 0).select(*CLUSTER, "size")
    line = G.to_array(mean.select(*CLUSTER, "seq", "x", "y"), CLUSTER)
    return line.join(size, CLUSTER).withColumns({
        "length": G.line_length(F.col("line")), "entry": F.element_at("line", 1), "exit": F.element_at("line", -1)})


def is_short_turn(scene_unit: Column) -> Column:
    """Short U-turn like candidates of the one intersection where they are noise."""
    length, line = F.col("length"), F.col("line")
    limit = F.when(scene_unit == "pixel", 350.0).otherwise(12.0)
    straight = G.gap(F.element_at(line, -1), F.element_at(line, 1)) / F.greatest(length, F.lit(1e-9))
    here = (F.col("dataset") == "CitySim") & (F.col("scene_id") == "CitySim_IntersectionA")
    return here & (F.size(line) >= 4) & (length <= limit) & ((G.turn_dot(line) < -0.35) | (straight < 0.65))


def split_short_turns(cands: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    flagged = cands.join(scenes.select(*SCENE, "unit"), SCENE).withColumn("_short", is_short_turn(F.col("unit")))
    w = W.partitionBy(*SCENE).orderBy("cluster_id")
    rejected = flagged.where("_short").select(
        *CLUSTER, "size", "line", F.format_string("r%03d", F.row_number().over(w) - 1).alias("reject_id"),
        F.lit("short_ignore_turn").alias("reason"), F.lit("ignore_track").alias("assignment_action"))
    return flagged.where(~F.col("_short")).drop("_short", "unit"), rejected


def _cells(lines: DataFrame, line: str) -> DataFrame:
    """Cell (cx, cy), as wide as the limit of the 90th percentile, of every point of a candidate's line."""
    # A little wider, so that rounding cannot put points at the limit two cells apart.
    side = F.when(F.col("unit") == "pixel", 110.0).otherwise(3.0) * (1 + 1e-9)
    points = lines.select(*CLUSTER, side.alias("_side"), F.explode(line).alias("p"))
    return points.select(*CLUSTER, *[F.floor(F.col(f"p.{v}") / F.col("_side")).cast("long").alias(f"c{v}") for v in "xy"])


def overlap_candidates(lines: DataFrame) -> DataFrame:
    """Pairs (cluster_id, earlier_id) of a scene that can overlap. lines: candidates with unit, _p100 and _p200.

    If the 90th percentile of a line's 100 gaps is within the limit, at most 10 gaps are beyond it. So of any 11 points
    one has a point of the other line in its own or a neighbouring cell: the 11 points in the cells that the fewest
    lines come near to are looked up, and a stretch of road that all routes of a scene share brings nothing together.
    """
    mine = _cells(lines, "_p100").groupBy(*CLUSTER, "cx", "cy").agg(F.count(F.lit(1)).alias("_points"))
    around = F.inline(F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    near = materialize(_cells(lines, "_p200").distinct().select(*CLUSTER, around).distinct(), "overlap-cells")
    crowd = near.groupBy(*SCENE, "cx", "cy").agg(F.count(F.lit(1)).alias("_crowd"))
    rarest = W.partitionBy(*CLUSTER).orderBy(F.coalesce("_crowd", F.lit(0)), "cx", "cy").rowsBetween(W.unboundedPreceding, -1)
    probes = mine.join(crowd, [*SCENE, "cx", "cy"], "left").withColumn("_before", F.coalesce(F.sum("_points").over(rarest), F.lit(0)))
    probes = probes.where(F.col("_before") < 11).select(*CLUSTER, "cx", "cy")
    met = probes.join(near.withColumnRenamed("cluster_id", "earlier_id"), [*SCENE, "cx", "cy"]).where("cluster_id != earlier_id")
    return met.select(*CLUSTER, "earlier_id").distinct()


def _with_gaps(pairs: DataFrame) -> DataFrame:
    """Puts mean and 90th percentile of the distances from the points of ``a__p100`` to the nearest of ``b__p200`` in their place."""
    kept = [f for f in pairs.schema.fields if f.name not in ("a__p100", "b__p200")]
    figures = ["mean_nearest", "p90_nearest"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (na, at_a, a), (nb, at_b, b) = points_of(batch.column("a__p100")), points_of(batch.column("b__p200"))
            out = np.empty((batch.num_rows, 2))
            for i in range(batch.num_rows):
                p, q = a[at_a[i] : at_a[i] + na[i]], b[at_b[i] : at_b[i] + nb[i]]
                d = np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1]).min(axis=1)
                out[i] = d.mean(), np.quantile(d, 0.9)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(v) for v in out.T)], [*(f.name for f in kept), *figures])

    return pairs.mapInArrow(measure, T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in figures]]))


def overlaps(cands: DataFrame, scenes: DataFrame) -> DataFrame:
    """Pairs (candidate, earlier candidate) of a scene that run along the same way, with the statistics.

    Earlier means longer, then larger, then smaller id. Only pairs that come near enough to each other are compared.
    """
    c = cands.join(scenes.select(*SCENE, "unit"), SCENE).where((F.col("dataset") != "CitySim") & (F.size("line") >= 4) & (F.col("length") > 1e-9))
    fields = ["cluster_id", "size", "length", "line", "_p100", "_p200"]
    c = G.with_resampled(G.with_resampled(c, 100, name="_p100"), 200, name="_p200")
    c = materialize(c.select(*SCENE, "unit", *fields), "overlap-lines")
    a = c.select(*SCENE, "unit", *[F.col(f).alias(f"a_{f}") for f in fields])
    b = c.select(*SCENE, *[F.col(f).alias(f"b_{f}") for f in fields])
    order = lambda p: F.struct(-F.col(f"{p}_length"), -F.col(f"{p}_size"), F.col(f"{p}_cluster_id"))
    near = overlap_candidates(c).select(*SCENE, F.col("cluster_id").alias("a_cluster_id"), F.col("earlier_id").alias("b_cluster_id"))
    # b precedes a, hence a is the shorter line.
    pairs = a.join(near, [*SCENE, "a_cluster_id"]).join(b, [*SCENE, "b_cluster_id"]).where(order("b") < order("a"))
    pairs = pairs.withColumn("length_ratio", F.col("a_length") / F.col("b_length")).where(F.col("length_ratio") >= 0.55)
    pairs = pairs.withColumns({
        "start_dot": G.direction_dot(F.col("a_line"), F.col("b_line"), True),
        "end_dot": G.direction_dot(F.col("a_line"), F.col("b_line"), False),
    }).where(F.least("start_dot", "end_dot") >= 0.85)
    pairs = _with_gaps(pairs.select(*SCENE, "unit", "a_cluster_id", "b_cluster_id", "b_length", "b_size", "length_ratio", "start_dot", "end_dot", "a__p100", "b__p200"))
    pixel = F.col("unit") == "pixel"
    near = (F.col("mean_nearest") <= F.when(pixel, 60.0).otherwise(1.6)) & (F.col("p90_nearest") <= F.when(pixel, 110.0).otherwise(3.0))
    return pairs.where(near).select(
        *SCENE, F.col("a_cluster_id").alias("cluster_id"), F.col("b_cluster_id").alias("earlier_id"), F.col("b_length").alias("earlier_length"),
        F.col("b_size").alias("earlier_size"), "length_ratio", "start_dot", "end_dot", "mean_nearest", "p90_nearest")


def prune_overlaps(cands: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep the first of every group of overlapping candidates: the lexicographically first independent set.

    A candidate is settled once every earlier overlapping one is: kept if all of those are pruned, pruned if
    one of them is kept. At least one candidate per scene settles in each round, so this ends.
    """
    edges = materialize(edges, "overlaps")
    state = materialize(cands.select(*CLUSTER, F.lit(None).cast("boolean").alias("kept")), "prune")
    while True:
        earlier = state.select(*SCENE, F.col("cluster_id").alias("earlier_id"), F.col("kept").alias("_k"))
        seen = edges.join(earlier, [*SCENE, "earlier_id"]).groupBy(*CLUSTER).agg(
            F.max(F.coalesce(F.col("_k"), F.lit(False))).alias("_any_kept"), F.count_if(F.col("_k").isNull()).alias("_open"))
        last = state
        state = state.join(seen, CLUSTER, "left").select(
            *CLUSTER,
            F.coalesce("kept", F.when(F.col("_any_kept"), False).when(F.coalesce("_open", F.lit(0)) == 0, True)).alias("kept"))
        state = materialize(state, "prune")
        discard(last)
        if state.where(F.col("kept").isNull()).isEmpty():
            break
    kept = cands.join(state.where("kept").select(*CLUSTER), CLUSTER, "left_semi")
    owner = edges.join(state.where("kept").select(*SCENE, F.col("cluster_id").alias("earlier_id")), [*SCENE, "earlier_id"])
    first = owner.groupBy(*CLUSTER).agg(F.min_by(
        F.struct("earlier_id", "length_ratio", "mean_nearest", "p90_nearest"),
        F.struct((-F.col("earlier_length")), (-F.col("earlier_size")), "earlier_id")).alias("_o"))
    pruned = cands.join(first, CLUSTER).select(
        *CLUSTER, "size", "length", F.col("_o.earlier_id").alias("kept_cluster_id"), "_o.length_ratio", "_o.mean_nearest", "_o.p90_nearest",
        F.lit("overlapping_duplicate_candidate").alias("reason"), F.lit("ui_prune_keep_longest").alias("action"))
    return kept, pruned


def manual_selection(cands: DataFrame, decisions: DataFrame, allow_missing: bool = False) -> tuple[DataFrame, DataFrame]:
    """Apply a table of decisions (scene, cluster_id, decision in accepted/deleted/rejected).

    Returns accepted candidates and new rejects. Decisions about unknown candidates are an error unless allowed.
    """
    missing = decisions.join(cands.select(*CLUSTER), CLUSTER, "left_anti")
    if not allow_missing and not missing.isEmpty():
        raise ValueError("manual selection references missing cluster ids")
    pick = lambda d: cands.join(decisions.where(F.col("decision") == d).select(*CLUSTER), CLUSTER, "left_semi")
    w = W.partitionBy(*SCENE).orderBy("cluster_id")
    rejects = pick("rejected").withColumns({
        "reject_id": F.format_string("r%03d", F.row_number().over(w) - 1),
        "reason": F.lit("manual_layer_mismatch"), "assignment_action": F.lit("ignore_track")})
    return pick("accepted"), rejects


def final_paths(cands: DataFrame, id_prefix: str = "p") -> DataFrame:
    """Points of the final paths: 12 control points, 100 samples, geometry. Linear interpolation throughout."""
    line = G.with_resampled(G.with_resampled(cands, 12), 100)
    dense = line.select(*CLUSTER, F.posexplode("line").alias("seq", "p")).select(*CLUSTER, F.col("seq").cast("long").alias("seq"), "p.x", "p.y")
    shaped = G.path_geometry(dense, CLUSTER)
    w = W.partitionBy(*SCENE).orderBy("cluster_id")
    names = cands.select(*CLUSTER, "size").withColumns({
        "path_id": F.format_string(f"{id_prefix}%03d", F.row_number().over(w) - 1),
        "type": F.lit("unknown"), "width": F.lit(3.5), "speed_limit": F.lit(-1.0)})
    return shaped.join(names, CLUSTER)


def path_lines(path_points: DataFrame) -> DataFrame:
    return G.to_array(path_points.select(*SCENE, "path_id", "seq", "x", "y"), [*SCENE, "path_id"])


def track_path_gaps(tracks: DataFrame, path_lines_: DataFrame, n: int = 100) -> DataFrame:
    """Mean distance between every track and every path of its scene, both resampled to n points."""
    keys = [*SCENE, "track_id"]
    t = G.to_array(G.resample(tracks.select(*keys, "frame", "x", "y"), keys, n, "frame"), keys, "track")
    p = G.with_resampled(path_lines_, n)
    return t.join(p, SCENE).select(*keys, "path_id", G.mean_gap(F.col("track"), F.col("line")).alias("mean_gap"))


def coverage(gaps: DataFrame, threshold: Column | float = 3.5) -> DataFrame:
    """Share of tracks whose nearest path is close enough, per scene."""
    near = gaps.groupBy(*SCENE, "track_id").agg(F.min("mean_gap").alias("gap"))
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    out = near.groupBy(*SCENE).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("gap") <= limit).alias("assigned"), F.avg("gap").alias("mean_distance"))
    p95 = bounded.quantile_columns(near, SCENE, F.col("gap"), {"p95_distance": 0.95})
    return out.join(p95, SCENE).withColumn("coverage", F.col("assigned") / F.greatest("total", F.lit(1)))


def quality_report(path_points: DataFrame, gaps: DataFrame, scenes: DataFrame, enforce_uniqueness: bool = False) -> DataFrame:
    """One row per path: geometry, metadata and uniqueness checks, with the coverage of its scene."""
    lines = path_lines(path_points)
    meta = path_points.groupBy(*SCENE, "path_id").agg(
        F.max("type").alias("type"), F.max("width").alias("width"),
        F.min("seq").alias("_s0"), F.count(F.lit(1)).alias("n_points"))
    nearest = gaps.groupBy(*SCENE, "path_id").agg(
        F.min("mean_gap").alias("min_gap_to_track"), F.min_by("track_id", F.struct("mean_gap", "track_id")).alias("nearest_track_id"))
    pixel = F.col("unit") == "pixel"
    cover = gaps.join(scenes.select(*SCENE, "unit"), SCENE)
    cover = cover.groupBy(*SCENE, "unit", "track_id").agg(F.min("mean_gap").alias("gap")).groupBy(*SCENE, "unit").agg(
        F.avg((F.col("gap") <= F.when(pixel, 20.0).otherwise(3.5)).cast("double")).alias("coverage"))
    out = lines.join(meta, [*SCENE, "path_id"]).join(nearest, [*SCENE, "path_id"], "left").join(cover, SCENE, "left")
    geometry_ok = (F.size("line") >= 2) & ~G.self_intersects(F.col("line"))
    metadata_ok = (F.coalesce("path_id", F.lit("")) != "") & (F.coalesce("type", F.lit("")) != "") & F.col("width").isNotNull()
    unique = F.coalesce(F.col("min_gap_to_track") >= F.when(pixel, 1.0).otherwise(0.10), F.lit(True)) if enforce_uniqueness else F.lit(True)
    out = out.withColumns({"geometry_ok": geometry_ok, "metadata_ok": metadata_ok, "not_identical_to_raw_track": unique})
    return out.withColumn(
        "valid", F.col("geometry_ok") & F.col("metadata_ok") & F.col("not_identical_to_raw_track") & (F.coalesce("coverage", F.lit(0.0)) >= 0.90)
    ).select(*SCENE, "path_id", "n_points", "geometry_ok", "metadata_ok", "not_identical_to_raw_track", "min_gap_to_track",
             "nearest_track_id", "coverage", "valid")


def save_paths(path_points: DataFrame, report: DataFrame, folder: str, require_coverage: bool = True) -> None:
    """Write paths and report, or refuse if any check fails."""
    hard = ~(F.col("geometry_ok") & F.col("metadata_ok") & F.col("not_identical_to_raw_track"))
    bad = report.where(~F.col("valid") if require_coverage else hard)
    if not bad.isEmpty():
        raise ValueError("quality checks failed; refusing to save paths")
    qc = report.select(*SCENE, "path_id", "coverage", "min_gap_to_track", "nearest_track_id", "not_identical_to_raw_track")
    path_points.join(qc, [*SCENE, "path_id"], "left").write.partitionBy(*SCENE).parquet(f"{folder}/paths")
    report.write.partitionBy(*SCENE).parquet(f"{folder}/qc")
