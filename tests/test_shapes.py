"""Smoothing, geometry, matching and clustering against small plain references."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import smoothing
from trackloom.operators import clustering, distribution, geometry as G, kinematics, matching, routes

KEYS = ["dataset", "scene_id", "track_id"]


def line_rows(spark, lines, scene="s", dataset="inD", agent="car"):
    rows = [(dataset, scene, t, i, float(x), float(y), agent) for t, pts in lines.items() for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "dataset string, scene_id string, track_id string, frame long, x double, y double, agent_type string")


def test_weights_reproduce_cubics():
    t = np.arange(200) * 0.5
    cubic = 2 + 3 * t - 0.4 * t**2 + 0.01 * t**3
    np.testing.assert_allclose(smoothing.smooth(cubic, 0, 200, 51, 3), cubic, atol=1e-6)
    np.testing.assert_allclose(smoothing.smooth(cubic, 0, 200, 31, 3, 1, 0.5), 3 - 0.8 * t + 0.03 * t**2, atol=1e-6)
    assert smoothing.odd_window(10, 51, 3) == 9 and smoothing.odd_window(3, 51, 3) is None


@pytest.mark.parametrize("n", [2, 3, 8, 40, 2600])
def test_kinematics_in_chunks_equal_the_whole(spark, n):
    rng = np.random.default_rng(n)
    x, y = np.cumsum(rng.normal(1, 0.1, n)), np.cumsum(rng.normal(0, 0.1, n))
    rows = spark.createDataFrame([("d", "s", "1", i, float(x[i]), float(y[i])) for i in range(n)], "dataset string, scene_id string, track_id string, frame long, x double, y double")
    got = sorted(kinematics.add_kinematics(rows, KEYS, 10.0).collect(), key=lambda r: r.frame)
    win, dwin = smoothing.odd_window(n, 51, 3), smoothing.odd_window(n, 31, 3)
    sx = smoothing.smooth(x, 0, n, win, 3) if win else x
    vx = smoothing.smooth(sx, 0, n, dwin, 3, 1, 0.1) if dwin else np.gradient(sx, 0.1)
    assert len(got) == n
    np.testing.assert_allclose([r.x for r in got], sx, atol=1e-8)
    np.testing.assert_allclose([r.vx for r in got], vx, atol=1e-6)


def test_resample_keeps_ends_and_spacing(spark):
    rng = np.random.default_rng(0)
    p = np.cumsum(rng.normal(1, 0.3, (70, 2)), axis=0)
    p[20] = p[19]
    df = line_rows(spark, {"a": p, "dot": [(3, 4)] * 5})
    got = {t: np.array([(r.x, r.y) for r in sorted(G.resample(df, KEYS, 50, "frame").where(F.col("track_id") == t).collect(), key=lambda r: r.seq)]) for t in ("a", "dot")}
    arc = np.r_[0, np.cumsum(np.hypot(*np.diff(p, axis=0).T))]
    keep = np.r_[True, np.diff(arc) > 1e-9]
    at = np.linspace(0, arc[-1], 50)
    np.testing.assert_allclose(got["a"], np.c_[np.interp(at, arc[keep], p[keep, 0]), np.interp(at, arc[keep], p[keep, 1])], atol=1e-8)
    np.testing.assert_allclose(got["dot"], [(3, 4)] * 50)


def frechet(a, b):
    d = np.linalg.norm(a[:, None] - b[None], axis=-1)
    c = np.full(d.shape, np.inf)
    for i in range(len(a)):
        for j in range(len(b)):
            reach = 0 if i == j == 0 else min(c[i - 1, j] if i else np.inf, c[i, j - 1] if j else np.inf, c[i - 1, j - 1] if i and j else np.inf)
            c[i, j] = max(d[i, j], reach)
    return c[-1, -1]


def test_frechet_and_self_intersection(spark):
    rng = np.random.default_rng(7)
    pairs = [(rng.normal(0, 3, (20, 2)), rng.normal(0, 3, (15, 2))) for _ in range(4)]
    to = lambda a: [{"x": float(x), "y": float(y)} for x, y in a]
    df = spark.createDataFrame([(i, to(a), to(b)) for i, (a, b) in enumerate(pairs)], "i int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    for r in df.select("i", G.discrete_frechet(F.col("a"), F.col("b")).alias("f")).collect():
        a, b = pairs[r.i]
        assert r.f == pytest.approx(frechet(a, b))
    cross = [(0, 0), (2, 2), (2, 0), (0, 2)]
    straight = [(i * 0.1, i * 0.3) for i in range(30)]
    got = spark.createDataFrame([(1, to(cross)), (2, to(straight)), (3, to(cross[:3]))], "i int, l array<struct<x:double,y:double>>").select(
        "i", G.self_intersects(F.col("l")).alias("x")).collect()
    assert {r.i: r.x for r in got} == {1: True, 2: False, 3: False}


def test_tracks_find_their_route_and_direction(spark):
    s = np.linspace(0, 100, 120)
    routes_ = {"p000": np.c_[s, 0 * s], "p001": np.c_[s, 30 + 0.002 * s**2], "p002": np.c_[0 * s + 50, s - 50]}
    noise = np.random.default_rng(2)
    tracks = {"same": routes_["p000"] + noise.normal(0, 0.05, (120, 2)), "back": routes_["p001"][::-1] + 0.3, "away": np.c_[s, 500 + s], "still": [(1, 1)] * 40}
    t = line_rows(spark, tracks).unionByName(line_rows(spark, {"walker": routes_["p000"]}, agent="pedestrian"))
    scenes = t.select("dataset", "scene_id").distinct().withColumns({"unit": F.lit("meter"), "frame_rate": F.lit(25.0)})
    to = lambda a: [{"x": float(x), "y": float(y)} for x, y in a]
    paths = spark.createDataFrame([("inD", "s", k, to(v)) for k, v in routes_.items()], "dataset string, scene_id string, path_id string, line array<struct<x:double,y:double>>")
    got = {r.track_id: r for r in matching.assign(t, scenes, paths).collect()}
    assert (got["same"].status, got["same"].path_id, got["same"].invert) == ("assigned", "p000", False)
    assert (got["back"].status, got["back"].path_id, got["back"].invert) == ("assigned", "p001", True)
    assert got["away"].status == "unassigned" and got["away"].path_id is None and got["away"].best_candidate_path_id
    assert got["still"].status == "invalid_too_short" and got["walker"].status == "excluded_non_vehicle"


def test_run_compression(spark):
    df = spark.createDataFrame([(1, list("aaabbcccaaa")), (2, list("abab")), (3, list("aaaabaaa"))], "i int, q array<string>")
    got = {r.i: r.c for r in df.select("i", matching.compress_runs(F.col("q")).alias("c")).collect()}
    assert got == {1: ["a", "c", "a"], 2: ["a"], 3: ["a"]}


def brute_dbscan(v, eps, k):
    near = np.linalg.norm(v[:, None] - v[None], axis=-1) <= eps
    core = near.sum(1) >= k
    label, out = 0, np.full(len(v), -1)
    for i in range(len(v)):
        if core[i] and out[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if out[j] >= 0:
                    continue
                out[j] = label
                if core[j]:
                    stack.extend(np.flatnonzero(near[j] & (out < 0)))
            label += 1
    return out, core


def test_dbscan_matches_brute_force_across_blocks(spark):
    rng = np.random.default_rng(11)
    centers = rng.uniform(-40, 40, (6, 6))
    v = np.concatenate([c + rng.normal(0, 0.7, (120, 6)) for c in centers] + [rng.uniform(-60, 60, (40, 6)), np.repeat([[5.0] * 6], 300, axis=0)])
    v = v[rng.permutation(len(v))]
    eps = 1.6
    df = spark.createDataFrame([("d", "s", f"{i:06d}", [float(x) for x in row]) for i, row in enumerate(v)], "dataset string, scene_id string, id string, vector array<double>")
    got = {int(r.id): (r.label, r.core) for r in clustering.dbscan(df, spark.createDataFrame([("d", "s", eps)], "dataset string, scene_id string, eps double"), 5).collect()}
    want, core = brute_dbscan(v, eps, 5)
    assert [got[i][1] for i in range(len(v))] == core.tolist()
    assert [got[i][0] for i in range(len(v)) if core[i] or want[i] < 0] == [int(w) for i, w in enumerate(want) if core[i] or want[i] < 0]
    assert all((got[i][0] >= 0) == (want[i] >= 0) for i in range(len(v)))


@pytest.mark.parametrize("pivots", [1, 8, 32])
def test_pivots_only_steer_the_work(spark, pivots):
    """Labels are those of all pairs for any number of pivots; with enough of them most pairs are never compared."""
    rng = np.random.default_rng(12)
    v = np.concatenate([c + rng.normal(0, 0.3, (200, 8)) for c in rng.uniform(-9, 9, (12, 8))] + [rng.uniform(-9, 9, (100, 8))])
    df = spark.createDataFrame([("d", s, f"{i:06d}", row) for s in ("s", "t") for i, row in enumerate(v.tolist())], "dataset string, scene_id string, id string, vector array<double>")
    eps = spark.createDataFrame([("d", "s", 0.9), ("d", "t", 0.9)], "dataset string, scene_id string, eps double")
    got = {(r.scene_id, int(r.id)): (r.label, r.core) for r in clustering.dbscan(df, eps, 5, pivots).collect()}
    want, core = brute_dbscan(v, 0.9, 5)
    for s in ("s", "t"):
        assert [got[s, i][1] for i in range(len(v))] == core.tolist()
        assert [got[s, i][0] for i in np.flatnonzero(core)] == want[core].tolist() and all((got[s, i][0] >= 0) == (want[i] >= 0) for i in range(len(v)))
    pairs = clustering._block_pairs(clustering._placed(df.join(eps, ["dataset", "scene_id"]), pivots), [])
    compared = pairs.agg(F.sum(F.size("a") * F.size("b"))).first()[0]
    print(pivots, "pivots:", compared, "of", 2 * len(v) ** 2)
    assert pivots < 32 or compared * 6 < 2 * len(v) ** 2


def test_pruning_keeps_the_first_of_a_chain(spark):
    """a overlaps b, b overlaps c, a does not overlap c: b goes, a and c stay."""
    x = np.linspace(0, 100, 50)
    lines = {0: np.c_[x, 0 * x], 1: np.c_[x * 0.99, 0 * x + 1.2], 2: np.c_[x * 0.98, 0 * x + 2.4], 3: np.c_[x, 0 * x + 40]}
    to = lambda a: [{"x": float(p), "y": float(q)} for p, q in a]
    c = spark.createDataFrame([("inD", "s", k, to(v), 10) for k, v in lines.items()], "dataset string, scene_id string, cluster_id int, line array<struct<x:double,y:double>>, size long")
    c = c.withColumn("length", G.line_length(F.col("line")))
    scenes = spark.createDataFrame([("inD", "s", "meter")], "dataset string, scene_id string, unit string")
    kept, pruned = routes.prune_overlaps(c, routes.overlaps(c, scenes))
    assert sorted(r.cluster_id for r in kept.collect()) == [0, 2, 3]
    assert [(r.cluster_id, r.kept_cluster_id) for r in pruned.collect()] == [(1, 0)]


def test_mmd_of_equal_samples_is_zero_and_blocks_add_up(spark):
    rng = np.random.default_rng(4)
    p, t = rng.normal(0, 2, (700, 2)), rng.normal(0.5, 2, (700, 2))
    rows = [("m", *map(float, (*a, *b))) for a, b in zip(p, t)] + [("same", *map(float, (*a, *a))) for a in p[:50]]
    df = spark.createDataFrame(rows, "model string, ax_pred double, ay_pred double, ax_true double, ay_true double")
    got = {r.model: r.mmd2 for r in distribution.mmd2_exact(df, ["model"]).collect()}

    def k(a, b):
        d = ((a[:, None] - b[None]) ** 2).sum(-1)
        return sum(np.exp(-d / (2 * w * w)) for w in (1, 2, 4, 8)) / 4

    n = len(p)
    want = (k(p, p).sum() - n) / (n * (n - 1)) + (k(t, t).sum() - n) / (n * (n - 1)) - 2 * k(p, t).mean()
    assert got["m"] == pytest.approx(want, abs=1e-10) and got["same"] == pytest.approx(0.0, abs=1e-12)


def test_short_paths_match_nothing(spark):
    to = lambda a: [{"x": float(x), "y": float(y)} for x, y in a]
    schema = "dataset string, scene_id string, path_id string, line array<struct<x:double,y:double>>"
    paths = spark.createDataFrame([("d", "s", "dot", to([(1, 1)])), ("d", "s", "still", to([(1, 1)] * 3)), ("d", "s", "fine", to([(0, 0), (0, 0), (5, 0)]))], schema)
    got = {(r.path_id, r.invert): len(r.line) for r in matching.directed(paths).collect()}
    assert got == {("fine", False): 2, ("fine", True): 2}


def test_fit_of_a_track_to_a_path(spark):
    """Scores against the definitions in plain numpy."""
    from trackloom.operators import pathfit
    rng = np.random.default_rng(3)
    to = lambda a: [{"x": float(x), "y": float(y)} for x, y in a]
    at, q = np.linspace(0, 60, 80), np.linspace(-5, 70, 100)
    cases = [(np.c_[at, 3 * np.sin(at / 9) + i][:: -1 if i == 2 else 1], np.c_[q, 3 * np.sin(q / 9) + rng.normal(0, 0.2, 100)]) for i in range(3)]
    df = spark.createDataFrame([(i, to(a), to(b)) for i, (a, b) in enumerate(cases)], "i int, track array<struct<x:double,y:double>>, line array<struct<x:double,y:double>>")
    for r in pathfit.scored(df).collect():
        track, line = cases[r.i]
        v, arc = np.diff(line, axis=0), np.r_[0, np.cumsum(np.hypot(*np.diff(line, axis=0).T))]
        near = []
        for p in track:
            u = np.clip([(p - a) @ w / (w @ w) for a, w in zip(line, v)], 0, 1)
            d = np.hypot(*(p - line[:-1] - u[:, None] * v).T)
            near.append((d.min(), arc[d.argmin()] + u[d.argmin()] * np.hypot(*v[d.argmin()]), v[d.argmin()] / np.hypot(*v[d.argmin()])))
        d, s, t = (np.array(x) for x in zip(*near))
        g = np.gradient(track, axis=0)
        dots = (g / np.linalg.norm(g, axis=1)[:, None] * t).sum(1)
        even = lambda p, a, w: np.c_[np.interp(w, a, p[:, 0]), np.interp(w, a, p[:, 1])]
        own = np.r_[0, np.cumsum(np.hypot(*np.diff(track, axis=0).T))]
        e, l = even(track, own, np.linspace(0, own[-1], 80)), even(line, arc, np.linspace(*np.percentile(s, [2, 98]), 80))
        want = [np.linalg.norm(e - l, axis=1).mean(), d.mean(), np.percentile(d, 90), frechet(e[::4], l[::4]), dots.mean(), dots[0], dots[-1], (np.diff(s) >= -1e-6).mean()]
        np.testing.assert_allclose([r.segment_mean, r.lateral_mean, r.lateral_p90, r.frechet, r.direction, r.start_dot, r.end_dot, r.monotonic], want, atol=1e-9)
