"""Matching through the path index against fitting every path of the scene."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import matching

LINE = "line array<struct<x:double,y:double>>"
SCENES = [("inD", "s"), ("NGSIM", "far"), ("inD", "one")]


def to(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def curve(rng, n, spread):
    turn = np.cumsum(rng.normal(0, 0.02, n)) + rng.uniform(0, 2 * np.pi)
    return rng.uniform(-spread, spread, 2) + np.cumsum(np.c_[np.cos(turn), np.sin(turn)], axis=0) * rng.uniform(0.5, 1.5)


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(5)
    routes = [(*SCENES[0], f"p{i:03d}", curve(rng, 100, 150)) for i in range(40)]
    # Two paths that are equal, and lanes side by side: ties and close runners-up.
    routes += [(*SCENES[0], "p900", routes[0][3]), (*SCENES[0], "p901", routes[1][3] + [0.5, 0.5])]
    routes += [(*SCENES[1], f"p{i:03d}", np.c_[np.linspace(0, 400, 60), np.full(60, 4.0 * i)]) for i in range(12)]
    routes += [(*SCENES[2], "p000", np.c_[np.linspace(0, 50, 30), np.zeros(30)])]
    tracks = []
    for i in range(30):
        base = routes[i % len(routes)][3]
        a = rng.integers(0, 40)
        tracks.append((*SCENES[0], f"t{i}", (base[a:a + 50] + rng.normal(0, 1.0, 2))[:: 1 if i % 3 else -1]))
    tracks += [(*SCENES[0], f"w{i}", curve(rng, 60, 200)) for i in range(10)]
    tracks += [(*SCENES[0], "away", np.c_[np.linspace(0, 30, 50), np.full(50, 9e4)]), (*SCENES[0], "tiny", np.c_[np.linspace(0, 1e-3, 50), np.zeros(50)])]
    tracks += [(*SCENES[1], f"l{i}", np.c_[np.linspace(20, 300, 90), 4.0 * i + np.linspace(0, 2.0, 90)]) for i in range(8)]
    # Beyond the end of the only path: all points project to one place, so no score is finite.
    tracks += [(*SCENES[2], "beyond", np.c_[np.linspace(80, 120, 40), np.zeros(40)]), (*SCENES[2], "on", np.c_[np.linspace(5, 40, 40), np.ones(40)])]
    tracks += [("inD", "none", "lost", np.c_[np.arange(20.0), np.arange(20.0)])]
    rows = [(d, s, t, i, float(x), float(y), "car") for d, s, t, p in tracks for i, (x, y) in enumerate(p)]
    t = spark.createDataFrame(rows, "dataset string, scene_id string, track_id string, frame long, x double, y double, agent_type string")
    units = t.select("dataset", "scene_id").distinct().withColumn("unit", F.lit("meter"))
    lines, _ = matching.sampled_tracks(t, units)
    paths = spark.createDataFrame([(d, s, k, to(p)) for d, s, k, p in routes], f"dataset string, scene_id string, path_id string, {LINE}")
    return matching.materialize(lines, "lines"), matching.materialize(matching.directed(paths), "variants")


@pytest.mark.parametrize("scale", [1.0, 0.7])
def test_same_best_and_second_best_from_fewer_fits(scene, scale):
    lines, variants = scene
    pairs = lines.select(*matching.TRACK).join(variants.select(*matching.SCENE, "path_id", "invert"), matching.SCENE)
    everything = {}
    for r in matching._refine(pairs, lines, variants, scale).collect():
        everything.setdefault((r.dataset, r.scene_id, r.track_id), []).append((r.score, r.path_id, r.invert, r.passed))
    got = {(r.dataset, r.scene_id, r.track_id): r for r in matching.best_matches(lines, variants, scale).collect()}
    assert got.keys() == everything.keys() and ("inD", "none", "lost") not in got
    for key, scores in everything.items():
        first, second = sorted(scores)[:2]
        r = got[key]
        assert (r.score, r.path_id, r.invert, r.passed) == pytest.approx(first) if np.isfinite(first[0]) else (r.path_id, r.invert) == first[1:3]
        finite = np.isfinite(second[0])
        assert r.best_alt_path_id == (second[1] if finite else None)
        assert (r.score_gap is None) != finite and (not finite or r.score_gap == pytest.approx((second[0] - first[0]) / max(abs(first[0]), 1e-6)))
    fitted = matching.fitted_pairs(lines, variants, scale)
    n = fitted.count()
    assert n == fitted.select(*matching.TRACK, "path_id", "invert").distinct().count()
    of_scene = F.col("scene_id") == "s"
    assert fitted.where(of_scene & ~F.col("track_id").isin("away", "tiny")).count() * 2.5 < pairs.where(of_scene & ~F.col("track_id").isin("away", "tiny")).count()
    print("fitted", n, "of", pairs.count())


def test_no_tracks_and_no_paths(scene):
    lines, variants = scene
    assert matching.best_matches(lines.limit(0), variants).count() == 0
    assert matching.best_matches(lines, variants.limit(0)).count() == 0
