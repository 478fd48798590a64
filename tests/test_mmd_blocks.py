import numpy as np
from pyspark.sql import functions as F

from trackloom import constants as K
from trackloom.operators import distribution


def test_equal_rows_are_weighted_points(spark, monkeypatch):
    """One row many times over fills no block, and counts as often as it stands there."""
    rng = np.random.default_rng(1)
    rows = [("a", 0.0, 0.0, 0.0, 0.0)] * 3000 + [("a", *map(float, r)) for r in rng.normal(0, 1, (1500, 4)).round(1)] + [("b", 1.0, 0.0, 0.0, 0.5)] * 2
    df = spark.createDataFrame(rows, "model string, ax_pred double, ay_pred double, ax_true double, ay_true double").repartition(4)
    found = {r["model"]: r for r in distribution.mmd2_v(df, ["model"]).collect()}
    for model in "ab":
        x = np.array([r[1:] for r in rows if r[0] == model])
        k = lambda u, v: sum(np.exp(-((u[:, None] - v[None]) ** 2).sum(-1) / (2 * w * w)).mean() for w in K.KERNEL_BANDWIDTHS) / len(K.KERNEL_BANDWIDTHS)
        assert found[model]["n"] == len(x)
        assert abs(found[model]["mmd2"] - (k(x[:, :2], x[:, :2]) + k(x[:, 2:], x[:, 2:]) - 2 * k(x[:, :2], x[:, 2:]))) < 1e-9
    seen = lambda a, b, same: F.array(*[F.when(same, F.size(a)).otherwise(0).cast("double")] * 3)
    monkeypatch.setattr(distribution, "_tile_sums", seen)
    held = {r["model"]: r["_xx"] for r in distribution._pairwise(df, ["model"]).collect()}
    assert held == {m: len({r for r in rows if r[0] == m}) for m in "ab"}
