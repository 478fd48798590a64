import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import bounded


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds almost all rows, many values are copies."""
    rng = np.random.default_rng(1)
    rows = [("hot", int(i), float(v)) for i, v in enumerate(np.r_[rng.normal(0, 50, 900), np.full(600, 3.25), -rng.exponential(1e-3, 200)])]
    rows += [("cold", int(i) * 7, float(v)) for i, v in enumerate(rng.normal(5, 1, 9))] + [("one", 3, 1.5)]
    return spark.createDataFrame(rows, "k string, frame long, v double"), rows


def by_key(rows):
    out = {}
    for k, f, v in rows:
        out.setdefault(k, []).append((f, v))
    return {k: sorted(r) for k, r in out.items()}


def test_quantiles_match_numpy(skewed):
    df, rows = skewed
    probs = [0.0, 0.01, 0.05, 0.37, 0.5, 0.75, 0.9, 0.99, 1.0]
    got = {r["k"]: r["quantiles"] for r in bounded.quantiles(df, ["k"], F.col("v"), probs).collect()}
    for k, pairs in by_key(rows).items():
        np.testing.assert_allclose(got[k], np.quantile([v for _, v in pairs], probs), rtol=1e-12, atol=1e-12)


def test_global_quantile_ignores_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    row = bounded.quantiles(df, [], F.col("v"), [0.5]).first()
    assert row["quantiles"] == [2.0] and row["quantiles_n"] == 2


@pytest.mark.parametrize("size", [4, 50, 100000])
def test_positions_sums_and_previous_do_not_depend_on_chunks(skewed, size):
    df, rows = skewed
    chunk = bounded.frame_chunk("frame", size)
    pos = {(r.k, r.frame): r.pos for r in bounded.positions(df, ["k"], ["frame"], chunk).collect()}
    run = {(r.k, r.frame): r.total for r in bounded.running_sums(df, ["k"], ["frame"], {"total": F.col("v")}, chunk).collect()}
    prev = {(r.k, r.frame): r.pv for r in bounded.previous_row(df, ["k"], ["frame"], {"pv": "v"}, chunk).collect()}
    nxt = {(r.k, r.frame): r.nv for r in bounded.previous_row(df, ["k"], ["frame"], {"nv": "v"}, chunk, forward=True).collect()}
    for k, pairs in by_key(rows).items():
        values = [v for _, v in pairs]
        sums = np.cumsum(values)
        for i, (f, _) in enumerate(pairs):
            assert pos[k, f] == i
            assert run[k, f] == pytest.approx(sums[i], abs=1e-9)
            assert prev[k, f] == (values[i - 1] if i else None)
            assert nxt[k, f] == (values[i + 1] if i + 1 < len(values) else None)


def test_nested_positions_follow_total_order(spark):
    rows = [(d, s, f) for d in "ab" for s in ("x", "y", "z") for f in range(0, 40, 3 if s == "y" else 5)]
    df = spark.createDataFrame(rows, "d string, s string, frame long").withColumn("m", F.lit("model"))
    got = bounded.nested_positions(df, ["d", "s"], ["frame"], bounded.frame_chunk("frame", 7), within=["m"]).collect()
    assert [(r.d, r.s, r.frame) for r in sorted(got, key=lambda r: r.pos)] == sorted(rows)
    assert sorted(r.pos for r in got) == list(range(len(rows)))


def test_top_per_group_large_n(skewed):
    df, rows = skewed
    got = bounded.top_per_group(df, ["k"], [F.col("frame")], 1200).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {k: min(1200, len(v)) for k, v in by_key(rows).items()}
