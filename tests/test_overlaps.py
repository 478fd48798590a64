import math
import random

import numpy as np
from pyspark.sql import functions as F

from trackloom.operators import geometry as G, routes

SCHEMA = "dataset string, scene_id string, cluster_id int, line array<struct<x:double,y:double>>, size long"


def candidates(spark, lines, dataset="inD"):
    rows = [(dataset, "s", i, [{"x": float(x), "y": float(y)} for x, y in line], 10 + i % 3) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("length", G.line_length(F.col("line")))


def scene(spark, unit="meter", dataset="inD"):
    return spark.createDataFrame([(dataset, "s", unit)], "dataset string, scene_id string, unit string")


def resampled(line, n):
    line = np.asarray(line, float)
    at = np.concatenate(([0], np.cumsum(np.hypot(*np.diff(line, axis=0).T))))
    return np.stack([np.interp(np.linspace(0, at[-1], n), at, line[:, k]) for k in (0, 1)], axis=1)


def near_pairs(lines, pixel=False):
    """All pairs compared: (shorter, longer) by distances alone."""
    length = [np.hypot(*np.diff(np.asarray(v, float), axis=0).T).sum() for v in lines]
    mean, far = (60, 110) if pixel else (1.6, 3.0)
    out = set()
    for i, a in enumerate(lines):
        for j, b in enumerate(lines):
            if i != j and (-length[j], -(10 + j % 3), j) < (-length[i], -(10 + i % 3), i) and length[i] >= 0.55 * length[j]:
                gaps = np.sqrt(((resampled(a, 100)[:, None] - resampled(b, 200)[None]) ** 2).sum(-1)).min(axis=1)
                if gaps.mean() <= mean and np.quantile(gaps, 0.9) <= far:
                    out.add((i, j))
    return out


def crowd(n, seed):
    """Routes along a few ways, shifted, cut and with a tenth of the way elsewhere."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        turn, shift, steps = rng.choice((0, 0.3, 0.6)), rng.uniform(0, 5), rng.randrange(25, 60)
        line = [(i * 2 * math.cos(turn), i * 2 * math.sin(turn) + shift) for i in range(steps)]
        if rng.random() < 0.5:  # a detour of about a tenth of the points
            for at in range(10, 10 + round(steps * rng.choice((0.05, 0.08, 0.12)))):
                line[at] = (line[at][0], line[at][1] + 2.5)
        more = 1 + len(out) / 1000  # lengths must differ, else rounding decides which line is the shorter one
        out.append([*line, (line[-1][0] + more * math.cos(turn), line[-1][1] + more * math.sin(turn))])
    return out


def test_overlaps_lose_no_pair(spark):
    for pixel in (False, True):
        lines = [[(x * (40 if pixel else 1), y * (40 if pixel else 1)) for x, y in line] for line in crowd(90, 4)]
        found = routes.overlaps(candidates(spark, lines), scene(spark, "pixel" if pixel else "meter")).collect()
        want = near_pairs(lines, pixel)
        dots = {(r.cluster_id, r.earlier_id) for r in found}
        assert len(want) > 100 and dots <= want
        # What distances alone allow and the rows leave out runs into another direction at an end.
        heading = lambda v, s: np.subtract(v[5], v[0]) if s else np.subtract(v[-1], v[-6])
        cosine = lambda u, v: float(u @ v / np.hypot(*u) / np.hypot(*v))
        assert all(min(cosine(heading(lines[i], s), heading(lines[j], s)) for s in (0, 1)) < 0.87 for i, j in want - dots)


def test_scene_of_many_candidates(spark):
    """10,000 candidates, 3,000 of which share their first stretch of road: few pairs are compared, every twin is found."""
    lines = []
    for i in range(5000):
        if i < 1500:
            turn = 2 * math.pi * i / 1500
            line = [(x, 0) for x in range(0, 41, 10)] + [(40 + r * math.cos(turn), r * math.sin(turn)) for r in range(25, 326, 50)]
        else:
            x, y = 1000 + 60 * (i % 60), 60 * (i // 60)
            line = [(x, y), (x + 15, y), (x + 30, y + 5), (x + 40, y + 20), (x + 40, y + 40)]
        lines += [line, [(x, y + 0.4) for x, y in line]]
    c = candidates(spark, lines)
    shown = G.with_resampled(G.with_resampled(c.withColumn("unit", F.lit("meter")), 100, name="_p100"), 200, name="_p200")
    pairs = routes.overlap_candidates(shown.select("dataset", "scene_id", "cluster_id", "unit", "_p100", "_p200"))
    twins = pairs.where("earlier_id = cluster_id + 1 and cluster_id % 2 = 0").count()
    count = pairs.count()
    print(count, "pairs of", 10_000 * 9_999)
    assert twins == 5000 and count < 500_000
