import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom import constants as K
from trackloom.operators import neighbors

SCHEMA = "dataset string, scene_id string, recording string, frame long, track_id string, x double, y double, heading double, vx double, vy double"


def make(spark, rows):
    return spark.createDataFrame([("d", "s", "r", f, t, float(x), float(y), float(h), float(u), float(v)) for f, t, x, y, h, u, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def crowd():
    rng = np.random.default_rng(5)
    rows = [(f, f"t{i}", *rng.uniform(-300, 300, 2), rng.uniform(-3, 3), *rng.normal(0, 5, 2)) for f in range(4) for i in range(60)]
    # Copies: many tracks on one spot, and two neighbours exactly on the same other spot.
    rows += [(9, f"c{i}", 10.0, 10.0, 0.3, 1.0, float(i)) for i in range(25)] + [(9, "n1", 30.0, 11.0, 0.0, 2.0, 0.0), (9, "n2", 30.0, 11.0, 0.0, 3.0, 0.0)]
    rows += [(11, "alone", 0.0, 0.0, 0.0, 1.0, 0.0), (12, "far1", 0.0, 0.0, 0.0, 1.0, 0.0), (12, "far2", 9000.0, 5.0, 0.0, 4.0, 0.0), (12, "far3", -20000.0, 0.0, 0.0, 2.0, 0.0)]
    return rows


def test_sectors_match_brute_force(spark, crowd):
    got = {(r.frame, r.track_id): r for r in neighbors.sector_distances(make(spark, crowd), 60.0).collect()}
    assert len(got) == len(crowd)
    for f, t, x, y, h, *_ in crowd:
        best = {}
        for g, u, ox, oy, *_ in crowd:
            d = math.hypot(ox - x, oy - y)
            if g != f or u == t or not 1e-6 < d <= 60.0:
                continue
            lon = math.cos(h) * (ox - x) + math.sin(h) * (oy - y)
            lat = -math.sin(h) * (ox - x) + math.cos(h) * (oy - y)
            if abs(lat) <= 1.0:
                name = "preceding" if lon > 2.5 else "following" if lon < -2.5 else None
            else:
                side = "left" if lat > 0 else "right"
                name = side + ("Alongside" if abs(lon) <= 2.5 else "Preceding" if lon > 0 else "Following")
            if name and d < best.get(name, math.inf):
                best[name] = d
        for n in K.SECTORS:
            value = got[f, t][f"dist_{n}"]
            assert (value is None) == (n not in best) and (value is None or value == pytest.approx(best[n], abs=1e-9))


@pytest.mark.parametrize("first", [60.0, 2.0])
def test_nearest_matches_brute_force(spark, crowd, first):
    got = {(r.frame, r.track_id): r for r in neighbors.nearest_neighbor(make(spark, crowd), first).collect()}
    for f, t, x, y, *_ in crowd:
        others = [math.hypot(ox - x, oy - y) for g, u, ox, oy, *_ in crowd if g == f and u != t]
        r = got[f, t]
        assert (r.distance is None) if not others else r.distance == pytest.approx(min(others), abs=1e-9)


def test_nearest_in_a_sparse_frame_of_many_agents(spark, monkeypatch):
    """Hundreds of metres between agents, a crowd far away, and pairs at one place: exact, without rows times cells."""
    rng = np.random.default_rng(4)
    n = 100_000
    p = np.r_[rng.uniform(0, 250_000, (n - 3000, 2)), rng.normal(1_000_000, 400, (2999, 2)), [[5e6, 5e6]]]
    p[:20] = p[20:40]
    joined = []
    near_pairs = neighbors._near_pairs

    def counted(*args):
        out = near_pairs(*args)
        joined.append(out.count())
        return out

    monkeypatch.setattr(neighbors, "_near_pairs", counted)
    frame = spark.createDataFrame(pd.DataFrame({"track_id": np.arange(n).astype(str), "x": p[:, 0], "y": p[:, 1]}))
    frame = frame.selectExpr("'inD' dataset", "'s' scene_id", "'r' recording", "1L frame", "track_id", "x", "y", "1.0D vx", "0.0D vy")
    lone = frame.limit(1).withColumn("frame", F.lit(2).cast("long"))
    nan = frame.limit(1).withColumns({"frame": F.lit(1).cast("long"), "track_id": F.lit("nan"), "x": F.lit(float("nan"))})
    got = neighbors.nearest_neighbor(frame.unionByName(lone).unionByName(nan)).toPandas()
    assert got[(got.frame == 2) | (got.track_id == "nan")].distance.isna().all() and len(got) == n + 2
    got = got[(got.frame == 1) & (got.track_id != "nan")].assign(i=lambda d: d.track_id.astype(int)).set_index("i").distance
    for i in [*range(25), n - 1, n - 2, n - 3, *rng.integers(0, n, 300)]:
        d = np.hypot(*(p - p[i]).T)
        d[i] = np.inf
        assert got[i] == pytest.approx(d.min(), abs=1e-6)
    assert max(joined) < 30 * n and sum(joined) < 100 * n


def test_feature_row_uses_the_sentinel(spark):
    row = neighbors.sector_distances(make(spark, [(1, "a", 0, 0, 0, 3, 4)]), 60.0, carry=["vx", "vy"])
    row = row.withColumn("ax", F.lit(1.0)).withColumn("ay", F.lit(2.0))
    assert row.select(neighbors.feature_row(row).alias("f")).first().f == [3.0, 1.0, 4.0, 2.0] + [-1.0] * 8
