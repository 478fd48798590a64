"""Which paths of a scene can still be the best or second best of a track: a grid over the paths, lower bounds of the score.

A distance to a path changes by no more than the way between two places. So the distances of a few probes of a track bound
those of all its points, and the score is at least

    mean distance of the evenly spaced points + 0.25 * the largest of them + 0.5 * the 90th percentile at the track's points.

The distance of a probe to a path is bounded from its grid cell, and cells are compared with paths once however many tracks
pass through. A scene's grid has 64 cells across the extent of its paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackloom.functions.lines import points_of
from trackloom.operators import geometry as G, pathfit
from trackloom.session import spread

SCENE = ["dataset", "scene_id"]
TRACK = [*SCENE, "track_id"]
CELLS = 64
PART = 16
PROBES = (0.0, 0.25, 0.5, 0.75, 1.0)
SLACK = 1e-6  # relative; rounding must not lose a path whose bound is its score
BANDS = 40  # doubling distances from one cell upwards; the last takes all beyond


def scene_grids(variants: DataFrame) -> DataFrame:
    """Origin and cell size of every scene's grid."""
    ends = variants.where(~F.col("invert")).select(
        *SCENE, *[f(f"line.{c}").alias(f"_{n}{c}") for c in "xy" for n, f in (("lo", F.array_min), ("hi", F.array_max))])
    box = ends.groupBy(*SCENE).agg(*[F.min(f"_lo{c}").alias(f"_{c}0") for c in "xy"], *[F.max(f"_hi{c}").alias(f"_{c}1") for c in "xy"])
    side = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(1e-6))
    return box.select(*SCENE, "_x0", "_y0", (side / CELLS).alias("_cell"))


def track_probes(lines: DataFrame, grids: DataFrame) -> DataFrame:
    """A row for each track and probe: its cell, the share of points that belong to it (``_w``), their mean distance from
    it (``_mean``), and the 10th percentile of the distances of all track points (``_p10``)."""
    n = F.size("track")
    last = n - 1
    even = G.bind(G.line_arcs(F.col("track")), lambda arc: G.at_arcs(
        F.col("track"), arc, F.transform(F.sequence(F.lit(0), last), lambda i: F.element_at(arc, -1) * i / F.greatest(last, F.lit(1)))))
    # Only every fourth even point has part in the Frechet distance; a probe is one of them.
    step = pathfit.FRECHET_STEP
    places = F.array(*[F.floor(last * p / step).cast("int") * step for p in PROBES])
    df = spread(lines, *TRACK).select(*TRACK, "track", even.alias("_even"), places.alias("_places"))
    df = df.select(*TRACK, "track", "_even", "_places", F.posexplode("_places").alias("probe", "_at"))
    # Points belong to the nearest probe along the track; each to one of them, also where probes coincide.
    border = lambda k: F.floor((F.get("_places", k - 1) + F.get("_places", k) + 1) / 2).cast("int")
    lower = F.when(F.col("probe") == 0, 0).otherwise(border(F.col("probe")))
    upper = F.when(F.col("probe") == len(PROBES) - 1, F.size("_even")).otherwise(border(F.col("probe") + 1))
    own = F.slice("_even", lower + 1, F.greatest(upper - lower, F.lit(0)))
    spot = F.get("_even", F.col("_at"))
    df = df.withColumns({"_spot": spot, "_own": own})
    df = df.withColumns({"_gaps": F.transform("_own", lambda p: G.gap(p, F.col("_spot"))), "_all": F.transform("track", lambda p: G.gap(p, F.col("_spot")))})
    mean = F.when(F.size("_gaps") > 0, G.array_mean(F.col("_gaps"))).otherwise(0.0)
    out = df.select(*TRACK, "probe", "_spot", (F.size("_gaps") / F.size("_even")).alias("_w"), mean.alias("_mean"), G.array_quantile(F.col("_all"), 0.1).alias("_p10"))
    cell = lambda c: F.floor((F.col(f"_spot.{c}") - F.col(f"_{c}0")) / F.col("_cell")).cast("long")
    return out.join(grids, SCENE).select(*TRACK, "probe", "_w", "_mean", "_p10", cell("x").alias("_cx"), cell("y").alias("_cy"))


def cell_distances(probes: DataFrame, variants: DataFrame, grids: DataFrame) -> DataFrame:
    """For every cell that a probe lies in and every path of its scene a lower bound of the distance, and its band."""
    part = lambda c: F.floor(F.col(c) / PART).alias(f"{c}_part")
    # At most PART * PART cells are one row, compared with a path as one matrix.
    cells = probes.select(*SCENE, "_cx", "_cy").distinct().groupBy(*SCENE, part("_cx"), part("_cy")).agg(F.collect_list("_cx").alias("_cx"), F.collect_list("_cy").alias("_cy"))
    lines_ = variants.where(~F.col("invert")).select(*SCENE, "path_id", "line")
    pairs = spread(cells.join(grids, SCENE).join(lines_, SCENE), *SCENE, "path_id", "_cx_part", "_cy_part")
    schema = "dataset string, scene_id string, path_id string, _cell double, _cx long, _cy long, _gap double"
    near = pairs.select(*SCENE, "path_id", "_x0", "_y0", "_cell", "_cx", "_cy", "line").mapInArrow(_cell_gaps, schema)
    near = near.withColumn("_d", F.greatest(F.lit(0.0), F.col("_gap") - F.col("_cell") * (0.5 ** 0.5)))
    return near.select(*SCENE, "_cx", "_cy", "path_id", "_gap", "_d", band(F.col("_d")).alias("_band"))


def _cell_gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distance between the middle of every cell and the path."""
    for batch in batches:
        sizes, first, xy = points_of(batch.column("line"))
        (x0, y0, cell), names = (batch.column(c).to_numpy() for c in ("_x0", "_y0", "_cell")), ("dataset", "scene_id", "path_id", "_cell")
        counts = batch.column("_cx").value_lengths().to_numpy(zero_copy_only=False)
        cx, cy = (batch.column(c).flatten() for c in ("_cx", "_cy"))
        gaps, ends = np.empty(len(cx)), np.cumsum(counts)
        at_x, at_y = cx.to_numpy(), cy.to_numpy()
        for i, z in enumerate(ends.tolist()):
            own = slice(z - counts[i], z)
            places = np.stack([x0[i] + (at_x[own] + 0.5) * cell[i], y0[i] + (at_y[own] + 0.5) * cell[i]], axis=1)
            gaps[own] = pathfit.project(places[None], xy[None, first[i] : first[i] + sizes[i]], sizes[i : i + 1])[0][0]
        row = pa.array(np.repeat(np.arange(batch.num_rows), counts))
        yield pa.RecordBatch.from_arrays([*(batch.column(n).take(row) for n in names), cx, cy, pa.array(gaps)], [*names, "_cx", "_cy", "_gap"])


def band(distance: Column) -> Column:
    """0 below one cell, then one more for each doubling."""
    doublings = F.floor(F.log2(F.greatest(distance / F.col("_cell"), F.lit(0.5)))).cast("int") + 1
    return F.when(distance < float("inf"), F.least(doublings, F.lit(BANDS))).otherwise(BANDS)


def nearest_paths(probes: DataFrame, near: DataFrame, n: int = 2) -> DataFrame:
    """The ``n`` paths nearest to the middle of every track, by its cell: where a good score is likely."""
    best = near.groupBy(*SCENE, "_cx", "_cy").agg(F.slice(F.array_sort(F.collect_list(F.struct("_gap", "path_id"))), 1, n).alias("_best"))
    middle = probes.where(F.col("probe") == len(PROBES) // 2).select(*TRACK, "_cx", "_cy")
    return middle.join(best, [*SCENE, "_cx", "_cy"]).select(*TRACK, F.explode("_best.path_id").alias("path_id"))


def possible_paths(limits: DataFrame, probes: DataFrame, near: DataFrame, grids: DataFrame) -> DataFrame:
    """Paths whose lower bound does not pass the track's limit. ``limits``: TRACK, limit (infinite: every path)."""
    top = F.col("limit") * (1.0 + SLACK) + SLACK
    middle = probes.where(F.col("probe") == len(PROBES) // 2).join(limits, TRACK).join(grids.select(*SCENE, "_cell"), SCENE)
    # 0.25 d + 0.5 (d - p10) passes the limit beyond this distance of the middle, and 0.25 d beyond four times the limit.
    reach = F.least(top * 4.0, (top + F.col("_p10") * 0.5) / 0.75)
    asked = middle.select(*TRACK, "_cx", "_cy", reach.alias("_reach"), F.explode(F.sequence(F.lit(0), band(reach))).alias("_band"))
    found = asked.join(near.select(*SCENE, "_cx", "_cy", "_band", "path_id", "_d"), [*SCENE, "_cx", "_cy", "_band"]).where(F.col("_d") <= F.col("_reach"))
    each = found.select(*TRACK, "path_id").join(probes, TRACK).join(near.select(*SCENE, "_cx", "_cy", "path_id", "_d"), [*SCENE, "_cx", "_cy", "path_id"])
    over = lambda c: F.greatest(F.lit(0.0), F.col("_d") - F.col(c))
    bound = F.sum(F.col("_w") * over("_mean")) + F.max("_d") * 0.25 + F.max(over("_p10")) * 0.5
    return each.groupBy(*TRACK, "path_id").agg(bound.alias("_bound")).join(limits, TRACK).where(F.col("_bound") <= top).select(*TRACK, "path_id")
