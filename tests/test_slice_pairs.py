import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom import constants as K
from trackloom.operators import slice_kernels, slice_quantiles, slices

RANGES = [(0.0, 0.3), (0.2, 0.6), (0.5, 1.0), (0.0, 1.0)]
SCHEMA = "dataset string, f double, g double, ax_true double, ay_true double, ax_m double, ay_m double, ax_k double, ay_k double"


def made_up(n, seed=4):
    """Ties in the features, a third of the rows equal, and rows without a value of g."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append(("a", 1.0, 0.0, *[0.0] * 6))
        else:
            rows.append((rng.choice("ab"), float(rng.randrange(12)), None if rng.random() < 0.3 else rng.gauss(0, 1), *[rng.gauss(0, 3) for _ in range(6)]))
    return rows


def mmd2(p, q):
    k = lambda a, b: sum(np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * w * w)) for w in K.KERNEL_BANDWIDTHS).sum() / len(K.KERNEL_BANDWIDTHS)
    n, xx, yy, xy = len(p), k(p, p), k(q, q), k(p, q)
    if n < 2:
        return 0.0
    u = (xx - n) / (n * (n - 1)) + (yy - n) / (n * (n - 1)) - 2 * xy / n**2
    return max((xx + yy - 2 * xy) / n**2 if u < -1e-12 else u, 0.0)


@pytest.mark.parametrize("block", [7, 1024])
def test_mmd_of_slices(spark, monkeypatch, block):
    monkeypatch.setattr(slice_kernels, "BLOCK", block)
    rows = made_up(90)
    wide = spark.createDataFrame(rows, SCHEMA)
    found = {tuple(r)[:5]: (r["samples"], r["mmd2"]) for r in slice_kernels.slice_mmd(wide, ["m", "k"], ["f", "g"], RANGES).collect()}
    expected = {}
    for scope in ("all", "a", "b"):
        for feature, at in (("f", 1), ("g", 2)):
            own = [r for r in rows if scope in ("all", r[0]) and r[at] is not None]
            for lo, hi in RANGES if len(own) >= 20 else ():
                low, high = np.quantile([r[at] for r in own], [lo, hi])
                part = np.array([r[3:] for r in own if low <= r[at] <= high])
                for i, model in enumerate(("m", "k")):
                    expected[scope, feature, lo, hi, model] = (len(part), mmd2(part[:, 2 + 2 * i : 4 + 2 * i], part[:, :2]))
    assert found.keys() == expected.keys()
    for key, (n, value) in expected.items():
        assert found[key][0] == n and found[key][1] == pytest.approx(value, abs=1e-9), key


def test_mmd_of_nothing(spark):
    assert not slice_kernels.slice_mmd(spark.createDataFrame([], SCHEMA), ["m"], ["f"], RANGES).collect()


def test_quantiles_of_slices(spark):
    """A third of the values are one number, and others differ in the last digits only."""
    rng = random.Random(8)
    rows = [("a", float(rng.randrange(10)), rng.choice([0.0, 2.0, 2.0 + 1e-13 * rng.randrange(50), rng.uniform(-3, 5)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "dataset string, f double, v double")
    bounds = slices._bounds(df, ["f"], RANGES, 20)
    runs = slices._bucket_rows(df, ["f"], bounds, ["v"]).groupBy("scope", "feature", "code", F.lit("x").alias("series"), F.col("v").alias("value")).agg(F.count("*").alias("n"))
    probs = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
    found = {(r["scope"], r["q_lo"], r["q_hi"]): (r["n"], r["quantiles"]) for r in slice_quantiles.slice_quantiles(runs, bounds, ["series"], probs).collect()}
    assert len(found) == 2 * len(RANGES)
    for (_, lo, hi), (n, quantiles) in found.items():
        low, high = np.quantile([r[1] for r in rows], [lo, hi])
        part = [r[2] for r in rows if low <= r[1] <= high]
        assert n == len(part) and quantiles == pytest.approx(np.quantile(part, probs), rel=1e-15, abs=1e-15)


def test_a_value_is_one_row_for_all_features(spark, monkeypatch):
    """Rows do not multiply with the features, and quantiles are the same however the values are cut into chunks."""
    rng = random.Random(5)
    rows = [("a", [[rng.uniform(1, 20), 0.0, 0.0, 0.0, rng.choice([7.0, rng.uniform(0, 90)])]], float(i % 9), None if i % 4 else float(i % 7), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)]
    wide = spark.createDataFrame(rows, "dataset string, state array<array<double>>, f double, g double, ax_true double, ax_m double")
    bounds = slices._bounds(wide, ["f", "g"], RANGES, 20)
    assert bounds.count() == 4
    one, two = (slice_quantiles.ttc_rows(wide, ["m"], names, bounds, [1.0]).agg(F.sum("n")).first()[0] for names in (["f"], ["f", "g"]))
    assert one == two
    whole = sorted(slice_quantiles.slice_ttc(wide, ["m"], ["f", "g"], RANGES, [1.0]).collect())
    monkeypatch.setattr(slice_quantiles, "CHUNK", 3)
    assert whole and sorted(slice_quantiles.slice_ttc(wide, ["m"], ["f", "g"], RANGES, [1.0]).collect()) == whole
