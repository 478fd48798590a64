import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom import constants as K
from trackloom.operators import distribution, kernel_sums, slice_kernels

SCHEMA = "model string, ax_pred double, ay_pred double, ax_true double, ay_true double"


def direct(p, q):
    return sum(np.exp(-((p[:, None] - q[None]) ** 2).sum(-1) / (2 * w * w)).sum() for w in K.KERNEL_BANDWIDTHS) / len(K.KERNEL_BANDWIDTHS)


@pytest.mark.parametrize("spread, size", [(0.0, 100), (1.0, 300), (40.0, 8)])
def test_large_groups_without_pairs(spark, monkeypatch, spread, size):
    """The sums of all pairs to the last digits, of close points and of points that need many boxes; no pair is compared."""
    rng = np.random.default_rng(2)
    rows = [(m, *map(float, r)) for m, n in (("a", size), ("b", size // 2)) for r in rng.normal(5, spread, (n, 4))] + [("a", 1.0, 2.0, 3.0, 4.0)] * 50
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(distribution, "FEW", 0)
    monkeypatch.setattr(distribution, "PART", 100)
    monkeypatch.setattr(distribution, "_tile_sums", lambda a, b, same: F.raise_error(F.lit("a tile")).cast("array<double>"))
    found = {r["model"]: r for r in distribution._pairwise(df, ["model"]).collect()}
    for model in "ab":
        x = np.array([r[1:] for r in rows if r[0] == model])
        p, q, r = x[:, :2], x[:, 2:], found[model]
        assert r["n"] == len(x)
        assert [r["_xx"], r["_yy"], r["_xy"]] == pytest.approx([direct(p, p), direct(q, q), direct(p, q)], abs=1e-13 * len(x) ** 2)


def test_without_group_and_with_odd_values(spark, monkeypatch):
    rows = [("a", 0.0, 1.0, float(i), 0.5) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = distribution.mmd2_exact(df, []).first()
    monkeypatch.setattr(distribution, "FEW", 0)
    found = distribution.mmd2_exact(df, []).first()
    assert found["n"] == 40 and found["mmd2"] == pytest.approx(expected["mmd2"], abs=1e-13)
    for odd in (None, float("nan"), float("inf")):
        bad = df.union(spark.createDataFrame([("b", odd, 0.0, 0.0, 0.0), ("b", 1.0, 0.0, 0.0, 0.0)], SCHEMA))
        got = {r["model"]: r["mmd2"] for r in distribution.mmd2_v(bad, ["model"]).collect()}
        assert np.isnan(got["b"]) and got["a"] == pytest.approx(distribution.mmd2_v(df, ["model"]).first()["mmd2"], abs=1e-13)


def test_vectors_grow_with_the_range_in_bandwidths_only():
    near, far = (kernel_sums.Axis.over(0.0, high, 1.0) for high in (30.0, 1e9))
    values = np.array([0.0, 5.0, 1e9])
    assert near.side is None and far.side == kernel_sums.REACH and far.vectors(values).shape[1] < 80
    assert far.boxes(values).tolist() == [0, 0, int(1e9 // kernel_sums.REACH)]


def test_slices_keep_one_vector_a_bucket(spark):
    """What the slices are read from does not grow with the rows."""
    rng, sizes = np.random.default_rng(3), []
    bounds = spark.createDataFrame([("all", "f", [0.0, 0.5, 1.0])], "scope string, feature string, edges array<double>")
    levels = kernel_sums.Levels(tuple((kernel_sums.Axis.over(-5.0, 5.0, w),) * 2 for w in K.KERNEL_BANDWIDTHS))
    for n in (50, 400):
        rows = [("a", float(f), *map(float, v)) for f, v in zip(rng.uniform(0.1, 0.9, n), rng.uniform(-5, 5, (n, 4)))]
        wide = spark.createDataFrame(rows, "dataset string, f double, ax_true double, ay_true double, ax_m double, ay_m double")
        sums = slice_kernels.bucket_sums(slice_kernels.points_of(wide, ["m"], ["f"]), ["m"], ["f"], bounds, levels).collect()
        assert sum(r["v"][0] for r in sums if r["cloud"] == slice_kernels.COUNT) == n
        sizes.append(len(sums))
    assert sizes[0] == sizes[1] == 2 * (1 + 2 * len(K.KERNEL_BANDWIDTHS))
