"""Medoids against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import medoids

SCHEMA = "g string, id string, vector array<double>"


def frame(spark, groups):
    return spark.createDataFrame([(g, f"{i:05d}", [float(x) for x in row]) for g, v in groups.items() for i, row in enumerate(v)], SCHEMA)


def brute(v):
    total = np.array([np.sqrt(((v - p) ** 2).sum(1)).sum() for p in v])
    return min(range(len(v)), key=lambda i: (round(total[i], 6), i)), total


def test_medoids_of_groups_of_all_kinds(spark):
    """A large group, one of which a third is one point, ties, pairs and single points."""
    rng = np.random.default_rng(8)
    groups = {
        "large": rng.normal(0, 5, (1500, 4)), "copies": np.r_[np.repeat([[3.0, 1.0]], 500, 0), rng.normal(0, 3, (1000, 2))],
        "pair": np.array([[0.0, 0.0], [1.0, 1.0]]), "single": np.array([[2.0]]), "square": np.array([[0.0, 0], [0, 1], [1, 0], [1, 1]]), "same": np.ones((40, 3)),
    }
    got = {r.g: r for r in medoids.medoids(frame(spark, groups), ["g"]).collect()}
    for g, v in groups.items():
        i, total = brute(v)
        assert (int(got[g].id), got[g].size) == (i, len(v)) and got[g].distance_sum == pytest.approx(total[i])
        assert list(got[g].vector) == v[i].tolist()
    assert medoids.medoids(frame(spark, groups).limit(0), ["g"]).count() == 0


def test_bounds_rule_most_members_out(spark):
    rng = np.random.default_rng(9)
    groups = {"a": rng.normal(0, 1, (1200, 2)) * [20, 3], "b": np.cumsum(rng.normal(0, 1, (800, 2)), axis=0)}
    nodes = frame(spark, groups).withColumn("weight", F.lit(1).cast("long"))
    bounds = medoids.materialize(medoids.sum_bounds(nodes, ["g"]), "bounds")
    total = {g: brute(v)[1] for g, v in groups.items()}
    for r in bounds.collect():
        assert r.bound <= total[r.g][int(r.id)] + 1e-6
    first = medoids.bounded.top_per_group(bounds, ["g"], [F.col("bound"), F.col("id")], medoids.FIRST)
    known = medoids.distance_sums(first.select("g", "id", "vector"), bounds, ["g"])
    left = medoids.open_nodes(bounds, known, ["g"]).count()
    print(left, "of", nodes.count(), "summed up after the first")
    assert left * 4 < nodes.count()


def test_blocks_of_a_large_group_are_few(spark, monkeypatch):
    """Rows are sent to every block of their group, so the number of blocks must not grow with the group."""
    monkeypatch.setattr(medoids, "BLOCK", 4)
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, (900, 3))
    nodes = frame(spark, {"a": v, "b": v[:5]}).withColumn("weight", F.lit(1).cast("long"))
    blocks = {r.g: r.n for r in medoids._dealt(nodes, ["g"], ["vector", "weight"], "m").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert 1 < blocks["a"] <= 16 and blocks["b"] <= 2
    sums = {(r.g, int(r.id)): r.distance_sum for r in medoids.distance_sums(nodes, nodes, ["g"]).collect()}
    assert len(sums) == 905
    np.testing.assert_allclose([sums["a", i] for i in range(900)], brute(v)[1])
    monkeypatch.setattr(medoids, "BLOCK_NUMBERS", 90)  # 30 rows of 3 numbers
    assert medoids._dealt(nodes.where("g = 'a'"), ["g"], ["vector"], "m").count() == 30
