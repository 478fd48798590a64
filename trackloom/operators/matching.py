"""Match every track to a directed route: coarse score, refined score, gates, fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trackloom import constants as K
from trackloom.functions import columns as C
from trackloom.operators import bounded, geometry as G, pathfit, pathindex
from trackloom.session import materialize

SCENE = ["dataset", "scene_id"]
# Limits of the flags in summaries.
LOW_ASSIGNED, HIGH_AMBIGUOUS, HIGH_INVERT = 0.90, 0.10, 0.60
TRACK = ["dataset", "scene_id", "track_id"]
SAMPLES = 80


def thresholds(unit: Column, dataset: Column, which: int, scale: float = 1.0) -> Column:
    t = K.MATCH_THRESHOLDS
    return F.when(unit == "pixel", t["pixel"][which]).when(dataset == "NGSIM", t["NGSIM"][which]).otherwise(
        t["default"][which]) * scale


def directed(paths: DataFrame) -> DataFrame:
    """Every path in both directions, without repeated points; a path of fewer than two points has no direction and matches
    nothing. ``paths``: scene, path_id, line."""
    both = paths.withColumn("invert", F.explode(F.array(F.lit(False), F.lit(True))))
    line = F.when(F.col("invert"), F.reverse("line")).otherwise(F.col("line"))
    both = both.withColumn("line", line).where(F.size("line") >= 2)
    index = F.sequence(F.lit(0), F.size("line") - 1)
    ok = lambda i: (i == 0) | (G.gap(F.col("line")[i], F.col("line")[F.greatest(i - 1, F.lit(0))]) > 1e-9)
    return both.withColumn("line", F.transform(F.filter(index, ok), lambda i: F.col("line")[i])).where(F.size("line") >= 2)


def sampled_tracks(tracks: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracks sampled at 80 points, and the verdict on those that are not matched at all."""
    finite = tracks.where(C.finite("x") & C.finite("y"))
    kind = tracks.groupBy(*TRACK).agg(F.min(C.is_route_vehicle(F.col("agent_type"))).alias("_vehicle"))
    arc = G.arc_length(finite.select(*TRACK, "frame", "x", "y"), TRACK, "frame")
    size = arc.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("_n"), F.max("s").alias("_len"))
    judged = kind.join(size, TRACK, "left").withColumn(
        "status",
        F.when(~F.col("_vehicle"), "excluded_non_vehicle").when(
            F.col("_n").isNull() | (F.col("_n") < 2) | (F.col("_len") <= 1e-9), "invalid_too_short"),
    )
    good = judged.where(F.col("status").isNull()).select(*TRACK, F.col("_len").alias("_total"))
    rows = arc.join(good, TRACK)
    line = G.to_array(G.sample_grid(rows, TRACK, SAMPLES, F.lit(0.0), F.col("_total")), TRACK, "track")
    line = line.join(scenes.select(*SCENE, "unit"), SCENE)
    return line, judged.where(F.col("status").isNotNull()).select(*TRACK, "status")


def coarse_score(track: Column, line: Column) -> Column:
    """mean + 0.3 p90 of nearest-vertex distances between thinned lines."""
    thin = lambda a, k: F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.greatest(F.lit(1), F.floor(F.size(a) / k).cast("int"))), lambda i: a[i])
    d = G.nearest_gaps(thin(track, 12), thin(line, 24))
    return G.array_mean(d) + G.array_quantile(d, 0.9) * 0.3


def coarse_scores(lines: DataFrame, variants: DataFrame) -> DataFrame:
    """Scores of all variants of a track's scene (an equi-join on the scene; a scene has few routes)."""
    pairs = lines.join(variants.select(*SCENE, "path_id", "invert", "line"), SCENE)
    return pairs.select(*TRACK, "path_id", "invert", coarse_score(F.col("track"), F.col("line")).alias("coarse"))


def _refine(candidates: DataFrame, lines: DataFrame, variants: DataFrame, scale: float) -> DataFrame:
    df = candidates.select(*TRACK, "path_id", "invert").join(lines, TRACK).join(variants, [*SCENE, "path_id", "invert"])
    df = pathfit.scored(df.select(*TRACK, "unit", "path_id", "invert", "track", "line"))
    t = [thresholds(F.col("unit"), F.col("dataset"), i, scale) for i in range(3)]
    unit_scale = F.greatest(F.lit(1.0), t[0] / 6.0)
    score = (
        F.col("segment_mean") + F.col("lateral_p90") * 0.5 + F.col("frechet") * 0.25
        + unit_scale * 2.0 * F.greatest(F.lit(0.0), 1.0 - F.col("direction"))
        + unit_scale * 10.0 * F.greatest(F.lit(0.0), 0.95 - F.col("monotonic"))
    )
    has = F.col("segment_mean").isNotNull() & ~F.isnan("segment_mean")
    passed = (
        has & (F.col("segment_mean") <= t[0]) & (F.col("lateral_mean") <= t[1]) & (F.col("lateral_p90") <= t[2])
        & (F.col("direction") >= 0.35) & (F.col("start_dot") >= -0.25) & (F.col("end_dot") >= -0.25)
        & (F.col("monotonic") >= 0.75)
    )
    return df.withColumn("score", F.when(has, score).otherwise(float("inf"))).withColumn("passed", F.coalesce(passed, F.lit(False)))


def fitted_pairs(lines: DataFrame, variants: DataFrame, scale: float = 1.0) -> DataFrame:
    """Full scores of every variant that can be a track's best or second best.

    The two paths nearest to the middle of a track are fitted first, in both directions. Of the others only those whose lower
    bound does not pass the second best score so far can still win (see ``pathindex``). A track whose first paths leave it
    without two finite scores is compared with every path of its scene.
    """
    keys = [*TRACK, "path_id"]
    grids = materialize(pathindex.scene_grids(variants), "grids")
    probes = materialize(pathindex.track_probes(lines, grids), "probes")
    near = materialize(pathindex.cell_distances(probes, variants, grids), "cell-distances")
    both = variants.select(*SCENE, "path_id", "invert")
    likely = pathindex.nearest_paths(probes, near)
    first = materialize(_refine(likely.join(both, [*SCENE, "path_id"]), lines, variants, scale), "first-fits")
    # Four scores for each track.
    second = F.get(F.array_sort(F.collect_list("score")), F.lit(1))
    limits = materialize(first.groupBy(*TRACK).agg(F.coalesce(second, F.lit(float("inf"))).alias("limit")), "limits")
    others = pathindex.possible_paths(limits, probes, near, grids).join(first.select(*keys).distinct(), keys, "left_anti")
    rest = materialize(_refine(others.join(both, [*SCENE, "path_id"]), lines, variants, scale), "further-fits")
    return first.unionByName(rest)


def best_matches(lines: DataFrame, variants: DataFrame, scale: float = 1.0, coarse_keep: int | None = None) -> DataFrame:
    """Best variant per track by the full score, with the runner-up and ambiguity.

    Every variant that can still win is fitted, so the result is that of fitting all. ``coarse_keep`` fits only as many as
    come first by the coarse score, and can miss the best one.
    """
    tie = [F.col("path_id"), F.col("invert")]
    if coarse_keep is None:
        final = fitted_pairs(lines, variants, scale)
    else:
        pairs = materialize(bounded.top_per_group(coarse_scores(lines, variants), TRACK, [F.col("coarse"), *tie], coarse_keep), "coarse")
        final = materialize(_refine(pairs, lines, variants, scale), "refined")
    # Two rows for each path of the track's scene.
    w = W.partitionBy(*TRACK).orderBy("score", *tie)
    final = final.withColumns({
        "_rank": F.row_number().over(w), "_alt": F.lead("score").over(w), "_alt_path": F.lead("path_id").over(w),
    }).where(F.col("_rank") == 1)
    usable = F.col("_alt").isNotNull() & (F.col("_alt") < float("inf")) & (F.col("score") < float("inf"))
    gap = F.when(usable, (F.col("_alt") - F.col("score")) / F.greatest(F.abs("score"), F.lit(1e-6)))
    return final.withColumns({
        "best_alt_path_id": F.when(usable, F.col("_alt_path")), "score_gap": gap,
        "ambiguous": F.coalesce(gap < 0.10, F.lit(False)),
    }).drop("_rank", "_alt", "_alt_path")


def compress_runs(ids: Column, min_run: int = 3) -> Column:
    """Run-length compress a short sequence: drop short runs (or keep the longest), then merge repeats."""
    start = F.array().cast("array<struct<id:string,n:int>>")

    def add(runs: Column, x: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        grown = F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct(x.alias("id"), (last["n"] + 1).alias("n"))))
        return F.when((F.size(runs) > 0) & (last["id"] == x), grown).otherwise(
            F.concat(runs, F.array(F.struct(x.alias("id"), F.lit(1).alias("n")))))

    runs = F.aggregate(ids, start, add)
    long_runs = F.filter(runs, lambda x: x["n"] >= min_run)
    longest = F.slice(F.filter(runs, lambda x: x["n"] == F.array_max(F.transform(runs, lambda y: y["n"]))), 1, 1)
    kept = F.transform(F.when(F.size(long_runs) > 0, long_runs).otherwise(longest), lambda x: x["id"])
    return F.aggregate(
        kept, F.array().cast("array<string>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) == x), acc).otherwise(F.array_append(acc, x)))


def lane_change_matches(lines: DataFrame, variants: DataFrame, first: int = 16) -> DataFrame:
    """Tracks that start on one route and then follow neighbouring ones of the same direction."""
    pairs = lines.join(variants.select(*SCENE, "path_id", "invert", "line"), SCENE)
    pairs = materialize(pathfit.lane_fit(pairs, first), "lane-fit")
    t = [thresholds(F.col("unit"), F.col("dataset"), i) for i in range(3)]
    starts = pairs.where(
        (F.col("first_mean") <= t[1]) & (F.col("first_p90") <= t[2])
        & (F.col("first_direction") >= 0.70) & (F.col("first_monotonic") >= 0.85)
    ).withColumn("initial_score", F.col("first_mean") + F.col("first_p90") * 0.3 + F.greatest(F.lit(0.0), 1.0 - F.col("first_direction")) * 2.0)
    initial = bounded.top_per_group(
        starts.select(*TRACK, "path_id", "invert", "initial_score", "first_mean", "first_p90"), TRACK,
        [F.col("initial_score"), F.col("path_id"), F.col("invert")], 1,
    ).withColumnsRenamed({"path_id": "initial_path_id", "invert": "initial_invert", "first_mean": "initial_lateral_mean", "first_p90": "initial_lateral_p90"})
    bundle = starts.drop("first_mean", "first_p90").join(
        initial.select(*TRACK, "initial_invert"), TRACK).where(F.col("invert") == F.col("initial_invert"))
    usable = bundle.where((F.col("direction") >= 0.70) & (F.col("monotonic") >= 0.85))
    points = usable.select(*TRACK, "unit", "path_id", "initial_score", F.posexplode("_points").alias("_i", "_v"))
    near = points.groupBy(*TRACK, "unit", "_i").agg(
        F.min(F.struct(F.col("_v.lateral").alias("lateral"), "initial_score", "path_id", F.col("_v.dot").alias("dot"), F.col("_v.advance").alias("advance"))).alias("_n"),
        F.count(F.lit(1)).alias("_lanes"),
    ).where(F.col("_lanes") >= 2)
    # 80 sampled points per track.
    seq = near.groupBy(*TRACK, "unit").agg(
        F.array_sort(F.collect_list(F.struct("_i", "_n.path_id", "_n.lateral"))).alias("_q"),
        F.avg("_n.lateral").alias("bundle_lateral_mean"), F.avg("_n.dot").alias("bundle_direction"), F.avg("_n.advance").alias("bundle_monotonic"),
    )
    seq = seq.withColumn("bundle_lateral_p90", G.array_quantile(F.transform("_q", lambda q: q["lateral"]), 0.9)).withColumn(
        "_seq", compress_runs(F.transform("_q", lambda q: q["path_id"])))
    out = seq.join(initial, TRACK).where(
        (F.size("_seq") >= 2) & (F.col("bundle_lateral_mean") <= t[1]) & (F.col("bundle_lateral_p90") <= t[2])
        & (F.col("bundle_direction") >= 0.70) & (F.col("bundle_monotonic") >= 0.85))
    lead_in = F.when(F.col("_seq")[0] != F.col("initial_path_id"), F.concat(F.array("initial_path_id"), "_seq")).otherwise(F.col("_seq"))
    out = out.withColumn("lane_change_path_sequence", lead_in).withColumn("lane_change_count", F.size("lane_change_path_sequence") - 1)
    score = F.col("initial_score") + F.col("bundle_lateral_mean") + F.col("bundle_lateral_p90") * 0.5 + F.col("lane_change_count") * 1.5
    return out.select(
        *TRACK, F.col("initial_path_id").alias("path_id"), F.col("initial_invert").alias("invert"), score.alias("score"),
        F.col("bundle_direction").alias("direction"), F.col("bundle_monotonic").alias("monotonic"), "initial_lateral_mean", "initial_lateral_p90",
        "bundle_lateral_mean", "bundle_lateral_p90", "lane_change_count", "lane_change_path_sequence")


_FIELDS = {
    "status": "string", "path_id": "string", "invert": "boolean", "score": "double", "segment_mean": "double", "lateral_mean": "double",
    "lateral_p90": "double", "frechet": "double", "direction": "double", "monotonic": "double", "reject_id": "string", "best_alt_path_id": "string",
    "best_candidate_path_id": "string", "match_mode": "string", "lane_change_count": "int", "initial_lateral_mean": "double", "initial_lateral_p90": "double",
    "bundle_lateral_mean": "double", "bundle_lateral_p90": "double", "lane_change_path_sequence": "array<string>", "score_gap": "double", "ambiguous": "boolean",
}


def _record(df: DataFrame, **given: Column) -> DataFrame:
    cols = []
    for name, kind in _FIELDS.items():
        source = given.get(name, F.col(name) if name in df.columns else F.lit(None))
        cols.append(source.cast(kind).alias(name))
    return df.select(*TRACK, *cols)


def assign(tracks: DataFrame, scenes: DataFrame, paths: DataFrame, rejects: DataFrame | None = None,
           reject_scale: float = K.REJECT_SCALE, coarse_keep: int | None = None) -> DataFrame:
    """One assignment record per track.

    Order of decisions: not a vehicle, too short, matches a reject prototype, matches a route, changes lanes
    between routes (NGSIM only), unassigned.
    """
    lines, verdicts = sampled_tracks(tracks, scenes)
    lines = materialize(lines, "sampled")
    no = F.lit(False)
    out = _record(verdicts, ambiguous=no)
    if rejects is not None:
        prototypes = materialize(directed(rejects.withColumnRenamed("reject_id", "path_id")), "prototypes")
        hit = best_matches(lines, prototypes, reject_scale, coarse_keep).where("passed")
        out = out.unionByName(_record(hit, status=F.lit("rejected_ignore_track"), reject_id=F.col("path_id"), path_id=F.lit(None), match_mode=F.lit(None)))
        lines = lines.join(hit.select(*TRACK), TRACK, "left_anti")
    variants = materialize(directed(paths), "variants")
    match = best_matches(lines, variants, 1.0, coarse_keep)
    out = out.unionByName(_record(match.where("passed"), status=F.lit("assigned"), match_mode=F.lit("shape")))
    open_ = lines.join(match.where("passed").select(*TRACK), TRACK, "left_anti")
    lanes = materialize(lane_change_matches(open_.where(F.col("dataset") == "NGSIM"), variants), "lanes")
    full = _refine(lanes, lines, variants, 1.0).select(*TRACK, "path_id", "invert", "segment_mean", "lateral_mean", "lateral_p90", "frechet")
    lanes = lanes.join(full, [*TRACK, "path_id", "invert"], "left")
    out = out.unionByName(_record(lanes, status=F.lit("assigned"), match_mode=F.lit("initial_ref_path_lane_change"), ambiguous=no))
    rest = open_.select(*TRACK).join(lanes.select(*TRACK), TRACK, "left_anti").join(match, TRACK, "left")
    return out.unionByName(_record(
        rest, status=F.lit("unassigned"), best_candidate_path_id=F.col("path_id"), path_id=F.lit(None),
        match_mode=F.lit(None), ambiguous=F.coalesce("ambiguous", no)))


def scene_summary(assignments: DataFrame, paths: DataFrame | None = None, rejects: DataFrame | None = None) -> DataFrame:
    """Counts by status, ratios and flags per scene, with the limits of the flags.

    Given the paths and reject prototypes that were matched against, also how many of each the scene has.
    """
    is_ = lambda s: F.count_if(F.col("status") == s)
    assigned = F.col("status") == "assigned"
    out = assignments.groupBy(*SCENE).agg(
        F.count(F.lit(1)).alias("n_tracks"), *[is_(s).alias(s) for s in K.STATUSES],
        F.count_if(assigned & F.col("ambiguous")).alias("ambiguous_assigned"),
        F.count_if(assigned & F.col("invert")).alias("invert_assigned"),
        F.count_if(assigned & (F.col("match_mode") == "shape")).alias("mode_shape"),
        F.count_if(assigned & (F.col("match_mode") != "shape")).alias("mode_lane_change"),
    )
    total = F.greatest(F.lit(1), F.col("assigned") + F.col("rejected_ignore_track") + F.col("unassigned"))
    kept = F.greatest(F.lit(1), F.col("assigned"))
    out = out.withColumns({
        "assigned_ratio": F.col("assigned") / total,
        "usable_ratio": (F.col("assigned") + F.col("rejected_ignore_track")) / total,
        "ambiguous_ratio": F.col("ambiguous_assigned") / kept,
        "invert_ratio": F.col("invert_assigned") / kept,
    })
    out = out.withColumns({
        "low_assigned_ratio": F.col("assigned_ratio") < LOW_ASSIGNED,
        "high_ambiguous_ratio": F.col("ambiguous_ratio") > HIGH_AMBIGUOUS,
        "high_invert_ratio": F.col("invert_ratio") > HIGH_INVERT,
        "low_assigned_limit": F.lit(LOW_ASSIGNED), "high_ambiguous_limit": F.lit(HIGH_AMBIGUOUS), "high_invert_limit": F.lit(HIGH_INVERT),
    }).drop("invert_assigned")
    for table, column, name in ((paths, "path_id", "n_paths"), (rejects, "reject_id", "n_rejects")):
        if table is not None:
            counts = table.groupBy(*SCENE).agg(F.countDistinct(column).alias(name))
            out = out.join(counts, SCENE, "left").na.fill(0, [name])
    return out


def best_unassigned(assignments: DataFrame, n: int = 20) -> DataFrame:
    return bounded.top_per_group(
        assignments.where(F.col("status") == "unassigned"), SCENE, [F.asc_nulls_last("score"), F.col("track_id")], n)


def batch_summary(scene_rows: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Totals by dataset and overall, with the number of flagged scenes and, if the wanted scenes are given, of those
    that gave no result (see :func:`missing_scenes`)."""
    flagged = F.col("low_assigned_ratio") | F.col("high_ambiguous_ratio") | F.col("high_invert_ratio")
    rows = scene_rows.withColumn("_missing", F.lit(0)).withColumn("_done", F.lit(1))
    if wanted is not None:
        gone = missing_scenes(wanted, scene_rows).withColumns({"_missing": F.lit(1), "_done": F.lit(0)})
        rows = rows.unionByName(gone, allowMissingColumns=True)
    out = rows.rollup("dataset").agg(
        F.sum("_done").alias("scenes"), F.coalesce(F.sum("n_tracks"), F.lit(0)).alias("tracks"),
        *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in K.STATUSES],
        F.count_if(flagged).alias("flagged_scenes"), *([F.sum("_missing").alias("missing_scenes")] if wanted is not None else []))
    return out.withColumn("dataset", F.coalesce("dataset", F.lit("(all)")))


def missing_scenes(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Scenes that should have been processed but have no data: the error list of a batch."""
    return wanted.select(*SCENE).distinct().join(have.select(*SCENE).distinct(), SCENE, "left_anti")
