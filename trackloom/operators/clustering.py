"""Density clustering of feature vectors per scene, as Spark joins over blocks of bounded size.

Points belong to the nearest of a few pivots and to a ring around it; the triangle inequality tells in which rings the
partners of a point can be, in any number of dimensions. Inside a ring, points are grouped into blocks of about BLOCK
rows; a task compares two blocks with matrix arithmetic and returns per-point results only: counts, or a
spanning forest of the connections it saw. Pairs of points are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trackloom.operators import bounded
from trackloom.functions.hashing import md5_code
from trackloom.session import discard, materialize

BLOCK = 256
SAMPLE = 1000
PIVOTS = 32
SCENE = ["dataset", "scene_id"]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(d2, 0.0))


def sampled_eps(points: DataFrame, percentile: float = 10.0, sample: int = SAMPLE) -> DataFrame:
    """eps per scene: a percentile of the non-zero distances within a fixed sample of ``sample`` points.

    The sample's size is part of the definition; one task holds its square of distances. Give ``dbscan`` an eps of your
    own where a sample will not do.
    """
    picked = bounded.top_per_group(points.withColumn("_h", md5_code(F.col("id"))), SCENE, [F.col("_h"), F.col("id")], sample)

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        d = _distances(*(2 * [np.stack(pdf["vector"]).astype(float)]))
        np.fill_diagonal(d, 0.0)
        away = d[d > 1e-7]
        eps = float(np.percentile(away, percentile)) if away.size else 1.0
        return pdf[SCENE].head(1).assign(eps=eps)

    return picked.select(*SCENE, "vector").groupBy(*SCENE).applyInPandas(measure, "dataset string, scene_id string, eps double")


def _pivots(points: DataFrame, n: int) -> DataFrame:
    """``n`` places per scene that lie far apart: from a sample of stated size, each the one farthest from those before it.
    They steer the work only; any choice gives the same labels."""
    picked = bounded.top_per_group(points.select(*SCENE, "id", "vector").withColumn("_h", md5_code(F.col("id"))), SCENE, [F.col("_h"), F.col("id")], SAMPLE)

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["vector"]).astype(float)
        chosen, gap = [0], _distances(v[:1], v)[0]
        while len(chosen) < n and gap.max() > 1e-7:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, _distances(v[chosen[-1:]], v)[0])
        return pdf[SCENE].head(1).assign(pivots=[v[chosen].tolist()])

    return picked.groupBy(*SCENE).applyInPandas(spread, "dataset string, scene_id string, pivots array<array<double>>")


def _placed(points: DataFrame, n: int) -> DataFrame:
    """Adds the distances to the scene's pivots (``_far``) and the nearest pivot (``_home``)."""
    gap = lambda p: F.sqrt(F.aggregate(F.zip_with("vector", p, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    df = points.join(_pivots(points, n), SCENE).withColumn("_far", F.transform("pivots", gap)).drop("pivots")
    return df.withColumn("_home", F.array_position("_far", F.array_min("_far")).cast("int") - 1)


def _cells(points: DataFrame, spread: bool) -> DataFrame:
    """Cells are rings of two eps around the pivots. A point's home is a ring of its nearest pivot; spread, it is in all
    rings in which a point within eps of it can have its home.

    Within eps of x, a point whose nearest pivot is q is at most eps nearer to or farther from q than x, and x is no more
    than two eps farther from q than from its own nearest pivot: both by the triangle inequality.
    """
    side = F.greatest(F.col("eps") * 2.0, F.lit(1e-12))
    own = F.get("_far", F.col("_home"))
    if not spread:
        return points.withColumns({"_c0": F.col("_home"), "_c1": F.floor(own / side)}).drop("_far", "_home")
    # A hair wider than eps, so that rounding cannot lose a partner.
    reach = F.col("eps") * 1.000001 + 1e-12
    near = F.filter(F.sequence(F.lit(0), F.size("_far") - 1), lambda q: F.get("_far", q) <= own + reach * 2.0)
    df = points.withColumn("_c0", F.explode(near))
    far = F.get("_far", F.col("_c0"))
    return df.withColumn("_c1", F.explode(F.sequence(F.floor((far - reach) / side), F.floor((far + reach) / side)))).drop("_far", "_home")


def _blocks(cells: DataFrame, fields: list[str], name: str) -> DataFrame:
    key = [*SCENE, "_c0", "_c1"]
    sizes = cells.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("_parts"))
    cut = cells.join(sizes, key).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    return cut.groupBy(*key, "_part").agg(
        F.collect_list(F.struct("id", "vector", *fields)).alias(name), F.first("eps").alias(f"eps_{name}")
    ).drop("_part")


def _block_pairs(points: DataFrame, fields: list[str], home_where: Column | None = None, reach_where: Column | None = None) -> DataFrame:
    home = points if home_where is None else points.where(home_where)
    reach = points if reach_where is None else points.where(reach_where)
    left = _blocks(_cells(home, False), fields, "a")
    right = _blocks(_cells(reach, True), fields, "b")
    return left.join(right, [*SCENE, "_c0", "_c1"]).select(*SCENE, F.col("eps_a").alias("eps"), "a", "b")


def _met(batches: Iterator[pa.RecordBatch], fields: dict[str, pa.DataType], body) -> Iterator[pa.RecordBatch]:
    """Rows of two blocks, taken one at a time from Arrow: as Python objects, those of one batch would be gigabytes.

    ``body``: from two lists of ids, which points are within eps, and the fields of b, to columns named as ``fields``.
    """
    for batch in batches:
        scene: list[list[str]] = [[], []]
        out: list[list] = [[] for _ in fields]
        for i in range(batch.num_rows):
            sides = (batch.column(n)[i].values for n in ("a", "b"))
            a, b = (dict(zip((f.name for f in v.type), v.flatten())) for v in sides)
            matrix = lambda v: v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
            near = _distances(matrix(a["vector"]), matrix(b["vector"])) <= batch.column("eps")[i].as_py() + 1e-12
            columns = body(a["id"].to_pylist(), b["id"].to_pylist(), near, *([b["component"]] if "component" in b else []))
            for kept, new in zip(out, columns):
                kept.extend(new)
            for kept, name in zip(scene, SCENE):
                kept.extend([batch.column(name)[i].as_py()] * len(columns[0]))
        yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.string()) for v in scene), *(pa.array(v, t) for v, t in zip(out, fields.values()))], [*SCENE, *fields])


def _degrees(batches):
    return _met(batches, {"id": pa.string(), "near": pa.int64()}, lambda a, b, near: (a, near.sum(axis=1).tolist()))


def _forest(batches):
    """Edges of a spanning forest over the connections between two blocks."""

    def edges(ids_a, ids_b, near):
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found = []
        for i, j in zip(*(k.tolist() for k in np.nonzero(near))):
            p, q = root(ids_a[i]), root(ids_b[j])
            if p != q:
                parent[p] = q
                found.append((ids_a[i], ids_b[j]))
        return [u for u, _ in found], [v for _, v in found]

    return _met(batches, {"u": pa.string(), "v": pa.string()}, edges)


def _borders(batches):
    """Lowest cluster label among the core points near each non-core point."""

    def lowest(ids_a, ids_b, near, component):
        labels = np.array(component.to_pylist(), dtype=object)
        rows = [(x, min(labels[m])) for x, m in zip(ids_a, near) if m.any()]
        return [x for x, _ in rows], [c for _, c in rows]

    return _met(batches, {"id": pa.string(), "component": pa.string()}, lowest)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components per scene by minimum labels with pointer jumping; label = smallest id.

    Every round is written to the shared folder, so a lost executor costs one round. Labels only get
    smaller, and it stops when none changes.
    """
    both = edges.select(*SCENE, "u", "v").unionByName(edges.select(*SCENE, F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = materialize(both, "edges")
    labels = materialize(nodes.select(*SCENE, "id", F.col("id").alias("component")), "labels")
    last = labels
    while True:
        near = both.join(labels.select(*SCENE, F.col("id").alias("v"), "component"), [*SCENE, "v"])
        near = near.groupBy(*SCENE, F.col("u").alias("id")).agg(F.min("component").alias("_near"))
        step = labels.join(near, [*SCENE, "id"], "left").select(*SCENE, "id", "component", F.least("component", "_near").alias("_new"))
        jump = step.select(*SCENE, F.col("id").alias("_new"), F.col("_new").alias("_far"))
        step = step.join(jump, [*SCENE, "_new"], "left").select(
            *SCENE, "id", F.least("_new", "_far").alias("component"), (F.least("_new", "_far") != F.col("component")).alias("_moved"))
        step = materialize(step, "labels")
        discard(last)
        labels, last = step.drop("_moved"), step
        if step.where("_moved").isEmpty():
            return labels


def dbscan(points: DataFrame, eps: DataFrame, min_samples: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """Labels per (scene, id): clusters numbered by their smallest core id, -1 for noise.

    A core point has at least ``min_samples`` points within eps, itself included; clusters are the connected
    components of core points; a border point joins the lowest-numbered cluster in reach.
    """
    points = materialize(_placed(points.select(*SCENE, "id", "vector").join(eps, SCENE), pivots), "points")
    near = _block_pairs(points, []).mapInArrow(_degrees, "dataset string, scene_id string, id string, near bigint")
    degree = near.groupBy(*SCENE, "id").agg(F.sum("near").alias("degree"))
    points = materialize(points.join(degree.withColumn("core", F.col("degree") >= min_samples).drop("degree"), [*SCENE, "id"]), "points")
    forest = _block_pairs(points, [], F.col("core"), F.col("core")).mapInArrow(
        _forest, "dataset string, scene_id string, u string, v string")
    core = components(points.where("core"), forest)
    labelled = points.join(core, [*SCENE, "id"], "left")
    border = _block_pairs(labelled, ["component"], ~F.col("core"), F.col("core")).mapInArrow(
        _borders, "dataset string, scene_id string, id string, component string")
    border = border.groupBy(*SCENE, "id").agg(F.min("component").alias("component"))
    # One row per cluster: few per scene.
    number = core.select(*SCENE, "component").distinct().withColumn(
        "label", F.row_number().over(W.partitionBy(*SCENE).orderBy("component")) - 1)
    found = core.unionByName(border).join(number, [*SCENE, "component"])
    return points.select(*SCENE, "id", "core").join(found.select(*SCENE, "id", "label"), [*SCENE, "id"], "left").na.fill(-1, ["label"])
