"""Fits, distances and cluster blocks on Arrow batches against plain versions, without Spark."""

import numpy as np
import pyarrow as pa

from trackloom.functions import lines
from trackloom.operators import geometry, clustering, pathfit, pathindex

POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def to(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def gap(p, line):
    out = []
    for a, b in zip(line[:-1], line[1:]):
        u = np.clip((p - a) @ (b - a) / max((b - a) @ (b - a), 1e-12), 0, 1)
        out.append(np.hypot(*(p - a - u * (b - a))))
    return min(out)


def test_lane_fit():
    """Tracks of different sizes against lines of different sizes, one line without extent to fit."""
    rng = np.random.default_rng(2)
    tracks = [np.c_[np.linspace(0, 30, n), rng.normal(0, 1, n)] for n in (5, 20, 20, 1)]
    paths = [np.c_[np.linspace(0, 40, n), np.zeros(n)] for n in (3, 9, 2, 4)]
    values, each, ends = pathfit._lane_batch(pa.array([to(t) for t in tracks] + [[]], POINTS), pa.array([to(p) for p in paths + paths[:1]], POINTS), 4)
    assert ends.tolist() == [0, 5, 25, 45, 46, 46] and np.isnan(values[4]).all()
    for i, (t, p) in enumerate(zip(tracks, paths)):
        side = np.array([gap(q, p) for q in t])
        np.testing.assert_allclose(each[ends[i]:ends[i + 1], 0], side, atol=1e-12)
        np.testing.assert_allclose(values[i, :2], [side[:4].mean(), np.quantile(side[:4], 0.9)], atol=1e-12)
        assert values[i, 5] == 1.0 and (each[ends[i]:ends[i + 1], 2] == 1.0).all()
    heading = np.hypot(*(tracks[1][1] - tracks[1][0]))
    assert abs(each[ends[1], 1] - (tracks[1][1] - tracks[1][0])[0] / heading) < 1e-12


def test_cell_distances():
    line = np.array([[0.0, 0.0], [10.0, 0.0], [10.0, 5.0]])
    batch = pa.RecordBatch.from_pydict({
        "dataset": ["d", "d"], "scene_id": ["s", "s"], "path_id": ["p", "q"], "_x0": [0.0, 1.0], "_y0": [0.0, 0.0], "_cell": [2.0, 1.0],
        "_cx": [[0, 3, -4], [7]], "_cy": [[0, 1, 2], [1]], "line": pa.array([to(line), to(line[:2])], POINTS)})
    (out,) = pathindex._cell_gaps(iter([batch]))
    assert out.column("path_id").to_pylist() == ["p", "p", "p", "q"] and out.column("_cx").to_pylist() == [0, 3, -4, 7]
    want = [gap(np.array(p), line) for p in ((1, 1), (7, 3), (-7, 5))] + [gap(np.array((8.5, 1.5)), line[:2])]
    np.testing.assert_allclose(out.column("_gap").to_numpy(), want, atol=1e-12)


def test_resampled_lines_stay_arrow():
    """Nulls and a line without length; no Python object for a point."""
    given = pa.array([to([(0, 0), (0, 0), (3, 4)]), None, to([(1, 2), (1, 2)]), to([(5, 6)])], POINTS)
    out = lines.resample_lines.func(given, pa.array([3, 3, 2, 2]))
    assert isinstance(out, pa.ListArray)
    assert out.to_pylist() == [to([(0, 0), (1.5, 2), (3, 4)]), None, to([(1, 2), (1, 2)]), to([(5, 6), (5, 6)])]


def blocks(rng, fields):
    block = lambda n, k: [{"id": f"{k}{i}", "vector": rng.normal(0, 1, 3).tolist(), **({"component": f"c{i % 2}"} if k in fields else {})} for i in range(n)]
    a, b = [block(4, "a"), block(2, "a")], [block(3, "b"), block(5, "b")]
    return a, b, pa.RecordBatch.from_pydict({"dataset": ["d", "e"], "scene_id": ["s", "t"], "eps": [1.5, 1.0], "a": a, "b": b})


def test_cluster_blocks():
    a, b, _ = blocks(np.random.default_rng(4), {"b"})
    batch = blocks(np.random.default_rng(4), set())[2]
    near = [[[np.linalg.norm(np.subtract(p["vector"], q["vector"])) <= e for q in y] for p in x] for x, y, e in zip(a, b, (1.5, 1.0))]
    (degrees,) = clustering._degrees(iter([batch]))
    assert degrees.column("near").to_pylist() == [sum(r) for m in near for r in m] and degrees.column("scene_id").to_pylist() == ["s"] * 4 + ["t"] * 2
    _, _, labelled = blocks(np.random.default_rng(4), {"b"})
    (borders,) = clustering._borders(iter([labelled]))
    want = [(p["id"], min(q["component"] for q, n in zip(y, r) if n)) for x, y, m in zip(a, b, near) for p, r in zip(x, m) if any(r)]
    assert list(zip(borders.column("id").to_pylist(), borders.column("component").to_pylist())) == want
    (forest,) = clustering._forest(iter([batch]))
    pairs = set(zip(forest.column("u").to_pylist(), forest.column("v").to_pylist()))
    assert pairs <= {(p["id"], q["id"]) for x, y, m in zip(a, b, near) for p, r in zip(x, m) for q, n in zip(y, r) if n} and pairs


def test_projection_on_batches(spark):
    """The nearest segment, the first of equally near ones, for lines of several sizes; points are dealt to all tasks."""
    rng = np.random.default_rng(12)
    paths = {"a": np.cumsum(rng.normal(1, 0.4, (30, 2)), axis=0), "b": np.array([[0.0, 0], [4, 0], [4, 4], [0, 4]]), "c": np.array([[1.0, 1], [1, 1], [5, 1]])}
    at = {"a": rng.normal(10, 8, (20, 2)), "b": np.array([[2.0, 2], [4, 0], [9, 9]]), "c": np.array([[1.0, 2], [3, 0]])}
    points = [(k, i, float(x), float(y)) for k, p in at.items() for i, (x, y) in enumerate(p)] + [("b", 9, None, 1.0)]
    vertices = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in p]) for k, p in paths.items()], "k string, line array<struct<x: double, y: double>>")
    out = geometry.projection(spark.createDataFrame(points, "k string, i long, x double, y double").coalesce(1), vertices, ["k"])
    assert "REPARTITION" in out._jdf.queryExecution().executedPlan().toString()
    found = {(r.k, r.i): r for r in out.collect()}
    assert len(found) == len(points) and found["b", 9].lateral is None
    for k, i, x, y in points[:-1]:
        line = paths[k]
        step = np.diff(line, axis=0)
        u = np.clip(((np.array([x, y]) - line[:-1]) * step).sum(1) / np.maximum((step**2).sum(1), 1e-12), 0, 1)
        gap = np.hypot(*(line[:-1] + step * u[:, None] - (x, y)).T)
        size, best = np.hypot(*step.T), int(np.flatnonzero(gap <= gap.min() + 1e-12)[0])
        r = found[k, i]
        assert r.segment == best
        np.testing.assert_allclose((r.lateral, r.s), (gap[best], size[:best].sum() + u[best] * size[best]), atol=1e-9)
