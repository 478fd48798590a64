"""Maximum mean discrepancy on every quantile slice from one pass over the rows.

A kernel sum over all pairs of two sets of points is the scalar product of two summed vectors (see ``kernel_sums``), and the
vector of a slice is the sum of those of its elementary buckets: the bounds of a (scope, feature) cut its axis into buckets,
and a slice is a run of them. So each row is added once for every scope and feature, however many slices hold it, and no
pair of rows is compared.

Equal rows are one point with a count. A bucket is dealt into parts of about ``BLOCK`` points, which are summed in tasks of
their own; a slice reads the vectors of its buckets, whose number and length don't grow with the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackloom import constants as K
from trackloom.operators import slices
from trackloom.operators.kernel_sums import Levels
from trackloom.session import materialize

BLOCK = 1 << 16
COUNT, TRUTH = -1, 0  # besides the models, which are numbered from 1
SUMS = "scope string, feature string, code int, cloud int, level int, i long, j long, v array<double>"
MMD = "scope string, feature string, q_lo double, q_hi double, model string, samples long, mmd2 double"


def _value_columns(models: list[str]) -> list[tuple[str, str]]:
    return [(f"ax_{m}", f"ay_{m}") for m in ("true", *models)]


def points_of(wide: DataFrame, models: list[str], features: list[str]) -> DataFrame:
    """dataset, features, truth and predictions of the different rows, with their counts (``_w``) and a hash (``_h``)."""
    values = [c for pair in _value_columns(models) for c in pair]
    rows = wide.select("dataset", *features, *[F.col(c).cast("double").alias(c) for c in values])
    points = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    return points.withColumn("_h", F.xxhash64(*rows.columns))


def bucket_sums(points: DataFrame, models: list[str], features: list[str], bounds: DataFrame, levels: Levels) -> DataFrame:
    """The summed vectors of truth and predictions, and the number of rows, of every part of every bucket."""
    clouds = _value_columns(models)
    names = [c.split()[0] for c in SUMS.split(", ")]
    rows = slices._bucket_rows(points, features, bounds, [*[c for pair in clouds for c in pair], "_w", "_h"])
    key = ["scope", "feature", "code"]
    parts = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_parts"))
    dealt = rows.join(parts, key).withColumn("_part", F.pmod("_h", "_parts")).drop("_h", "_parts")

    def compute(at: tuple, table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy().astype(float)
        weight = column("_w")
        out = [(COUNT, 0, 0, 0, np.array([weight.sum()]))]
        for cloud, (x, y) in enumerate(clouds):
            out += [(cloud, *found) for found in levels.sums(column(x), column(y), weight)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
        of_key = [pa.array([at[k].as_py()] * len(out), t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))]
        return pa.Table.from_arrays([*of_key, *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]], names)

    return dealt.groupBy(*key, "_part").applyInArrow(compute, SUMS)


def _not_finite(points: DataFrame, models: list[str]) -> DataFrame:
    """scope and, for truth and models, whether a value in it is null or not finite: then there is no discrepancy to give."""
    finite = lambda c: F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    bad = F.array(*[F.max(~(finite(x) & finite(y))) for x, y in _value_columns(models)])
    return points.groupBy("dataset").agg(bad.alias("bad")).withColumnRenamed("dataset", "scope").union(
        points.select(F.lit("all").alias("scope"), "*").groupBy("scope").agg(bad.alias("bad")))


def _of_slices(models: list[str], levels: Levels):
    """Sums the buckets of each slice of one scope and feature and multiplies the vectors."""

    def read(sums: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(sums) and len(bounds):
            lo, hi = (bounds[c].to_numpy()[:, None] for c in ("code_lo", "code_hi"))
            vectors: dict[tuple[int, int, int, int], np.ndarray] = {}
            for (cloud, level, i, j), part in sums.groupby(["cloud", "level", "i", "j"]):
                code = part["code"].to_numpy()[None, :]
                vectors[cloud, level, i, j] = ((code >= lo) & (code <= hi)).astype(float) @ np.stack(part["v"].to_list())
            count = vectors.pop((COUNT, 0, 0, 0))[:, 0]
            none = np.zeros(len(bounds))

            def product(one: int, other: int) -> np.ndarray:
                total = none.copy()
                for (cloud, level, i, j), vector in vectors.items():
                    for step_i, step_j in levels.neighbours(level) if cloud == one else ():
                        met = vectors.get((other, level, i + step_i, j + step_j))
                        total += none if met is None else (vector * met).sum(axis=1)
                return total / len(K.KERNEL_BANDWIDTHS)

            truth = product(TRUTH, TRUTH)
            own = [(product(m, m), product(m, TRUTH)) for m in range(1, len(models) + 1)]
            for at, row in enumerate(bounds.itertuples()):
                n, yy = count[at], truth[at]
                for m, (name, (same, across)) in enumerate(zip(models, own), 1):
                    xx, xy = same[at], across[at]
                    u = (xx - n) / (n * (n - 1)) + (yy - n) / (n * (n - 1)) - 2 * xy / (n * n) if n >= 2 else 0.0
                    value = (xx + yy - 2 * xy) / (n * n) if u < -1e-12 else u
                    value = float("nan") if row.bad[TRUTH] or row.bad[m] else max(value, 0.0)
                    out.append((row.scope, row.feature, row.q_lo, row.q_hi, name, round(n), value))
        return pd.DataFrame(out, columns=[c.split()[0] for c in MMD.split(", ")])

    return read


def slice_mmd(wide: DataFrame, models: list[str], features: list[str], ranges: list[tuple[float, float]], min_population: int = 20) -> DataFrame:
    """samples, mmd2 and mmd of every model on every slice; see ``slices.slice_metrics`` for ``wide`` and the slices.

    The statistic is that of ``distribution.mmd2_exact`` on the rows of the slice.
    """
    bounds = materialize(slices._bounds(wide, features, ranges, min_population), "slice-bounds")
    points = materialize(points_of(wide, models, features), "slice-points")
    xs, ys = ([pair[k] for pair in _value_columns(models)] for k in (0, 1))
    levels = Levels.over(points, xs, ys)
    sums = bucket_sums(points, models, features, bounds, levels)
    spans = bounds.select("scope", "feature", "edges", F.explode("ranges").alias("_r")).select(
        "scope", "feature", "_r.q_lo", "_r.q_hi",
        slices._code(F.col("_r.value_lo"), F.col("edges")).alias("code_lo"), slices._code(F.col("_r.value_hi"), F.col("edges")).alias("code_hi"))
    spans = spans.join(_not_finite(points, models), "scope")
    read = sums.groupBy("scope", "feature").cogroup(spans.groupBy("scope", "feature")).applyInPandas(_of_slices(models, levels), MMD)
    return read.withColumn("mmd", F.sqrt("mmd2"))


def exact_screened(wide: DataFrame, models: list[str], features: list[str], ranges: list[tuple[float, float]], r2_interval: tuple[float, float],
                   min_population: int = 20) -> DataFrame:
    """Every slice that passes the screen by R2, each set of rows once, with its regression metrics and discrepancy.

    All are exact on the rows of the slice already, so what passes needs no second look at the rows.
    """
    passed = slices.screen(slices.slice_metrics(wide, models, features, ranges, min_population), r2_interval)
    exact = slice_mmd(wide, models, features, ranges, min_population).drop("samples")
    return passed.join(exact, ["model", "scope", "feature", "q_lo", "q_hi"])
