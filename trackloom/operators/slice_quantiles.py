"""Exact quantiles, and with them the combined time-to-collision error, on every quantile slice.

A row is a value with its code (elementary bucket) on the axis of every feature of a scope, so it is sorted once and not once a
feature. The values of a (scope, series) are cut into chunks of about ``CHUNK`` rows, from a histogram of value buckets. A first
pass counts the rows of a chunk by feature and code; their sums over the codes of a slice, chunk after chunk, tell which ranks
of the slice a chunk holds. A second pass sorts a chunk and picks these. Equal rows are one row with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from trackloom.functions.columns import window_ttc
from trackloom.operators import slices, ttc
from trackloom.session import materialize

SCALE = 1024.0  # value buckets a unit of asinh
CHUNK = 100_000  # rows of a chunk, if no bucket alone holds more


def _value_bucket(value: Column) -> Column:
    """Order-preserving; every step is monotone in double arithmetic."""
    return F.floor(F.signum(value) * F.asinh(F.abs(value) * 1000.0) * SCALE)


def _spans(bounds: DataFrame) -> DataFrame:
    code = lambda c: slices._code(F.col(f"_r.{c}"), F.col("edges"))
    return bounds.select("scope", "feature", "edges", F.explode("ranges").alias("_r")).select(
        "scope", "feature", "_r.q_lo", "_r.q_hi", code("value_lo").alias("_c0"), code("value_hi").alias("_c1"))


def _chunked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``_chunk``, which does not decrease along ``value`` within ``keys``."""
    rows = rows.withColumn("_b", _value_bucket(F.col("value")))
    sizes = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_m"))
    # As many rows a key as there are value buckets.
    before = F.coalesce(F.sum("_m").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select(*keys, "_b", F.floor(before / CHUNK).alias("_chunk")), [*keys, "_b"]).drop("_b")


def _codes(table: pa.Table, width: int) -> np.ndarray:
    """The codes of a chunk, a row a feature; -1 where a value of the feature is missing."""
    codes = table.column("codes").combine_chunks()
    codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
    return np.ascontiguousarray(codes.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, width).T)


def _counts(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Rows by chunk, feature, code and bin: keys, _chunk, feature, code, bin, n."""
    schema = T.StructType([*[rows.schema[k] for k in [*keys, "_chunk"]], T.StructField("feature", T.StringType()), T.StructField("code", T.LongType()),
                           T.StructField("bin", T.LongType()), T.StructField("n", T.LongType())])

    def count(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, int] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            bins, n = table.column("bin").to_numpy().astype(np.int64), table.column("n").to_numpy()
            width = int(bins.max()) + 1
            for f, codes in enumerate(_codes(table, len(features))):
                ok = codes >= 0
                sums = np.bincount(codes[ok] * width + bins[ok], n[ok]) if ok.any() else np.zeros(0)
                for at in np.flatnonzero(sums):
                    where = (f, int(at // width), int(at % width))
                    found[where] = found.get(where, 0) + int(sums[at])
        named = [*[[g.as_py()] * len(found) for g in group], [features[f] for f, _, _ in found], [c for _, c, _ in found], [b for _, _, b in found], list(found.values())]
        kinds = [*[g.type for g in group], pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(named, kinds)], schema.names)

    return rows.groupBy(*keys, "_chunk").applyInArrow(count, schema)


def _pick(rows: DataFrame, wanted: DataFrame, keys: list[str], features: list[str], probs: list[float]) -> DataFrame:
    """Values of the wanted ranks that a chunk holds: keys, feature, q_lo, q_hi, _total, _i, side and _v."""
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("feature", T.StringType()), T.StructField("q_lo", T.DoubleType()),
                           T.StructField("q_hi", T.DoubleType()), T.StructField("_total", T.LongType()), T.StructField("_i", T.IntegerType()),
                           T.StructField("side", T.IntegerType()), T.StructField("_v", T.DoubleType())])
    grid = np.array(probs, float)

    def pick(group: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        value, n = left.column("value").to_numpy(), left.column("n").to_numpy()
        order = np.argsort(value, kind="stable")
        value, n = value[order], n[order]
        codes = _codes(left, len(features))[:, order] if len(order) else np.zeros((len(features), 0), np.int32)
        out: list[list] = [[] for _ in range(7)]
        for want in right.to_pylist():
            of = codes[features.index(want["feature"])]
            inside = np.flatnonzero((of >= want["_c0"]) & (of <= want["_c1"]))
            upto = want["_base"] + np.cumsum(n[inside])
            at = grid * (want["_total"] - 1)
            for side, ranks in enumerate((np.floor(at), np.ceil(at))):
                here = np.flatnonzero((ranks >= want["_base"]) & (ranks < want["_base"] + want["n"]))
                found = value[inside[np.searchsorted(upto, ranks[here], side="right")]]
                for column, v in zip(out, ([want["feature"]] * len(here), [want["q_lo"]] * len(here), [want["q_hi"]] * len(here), [want["_total"]] * len(here),
                                           here.tolist(), [side] * len(here), found.tolist())):
                    column.extend(v)
        kinds = [*[g.type for g in group[:-1]], pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        named = [*[[g.as_py()] * len(out[0]) for g in group[:-1]], *out]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(named, kinds)], schema.names)

    return rows.groupBy(*keys, "_chunk").cogroup(wanted.groupBy(*keys, "_chunk")).applyInArrow(pick, schema)


def coded_quantiles(rows: DataFrame, counts: DataFrame, bounds: DataFrame, features: list[str], series: list[str], probs: list[float]) -> DataFrame:
    """Linear-interpolation quantiles of every slice and series: scope, feature, q_lo, q_hi, series, quantiles and n.

    rows: scope, series, codes (by feature), value, n and _chunk, counted as ``counts``.
    """
    keys, name = ["scope", *series], ["scope", "feature", "q_lo", "q_hi", *series]
    inside = counts.join(_spans(bounds), ["scope", "feature"]).where(F.col("code").between(F.col("_c0"), F.col("_c1")))
    held = inside.groupBy(*name, "_c0", "_c1", "_chunk").agg(F.sum("n").alias("n"))
    within = W.partitionBy(*name)
    before = F.coalesce(F.sum("n").over(within.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wanted = held.withColumns({"_base": before, "_total": F.sum("n").over(within), "q_lo": F.col("q_lo").cast("double"), "q_hi": F.col("q_hi").cast("double")})
    picked = _pick(rows, wanted, keys, features, probs)
    each = picked.groupBy(*name, "_i").agg(*[F.max(F.when(F.col("side") == side, F.col("_v"))).alias(c) for side, c in enumerate("az")], F.max("_total").alias("_total"))
    at = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1) * (F.col("_total") - 1)
    each = each.withColumn("_q", F.col("a") + (F.col("z") - F.col("a")) * (at - F.floor(at)))
    return each.groupBy(*name).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias("quantiles"), F.max("_total").cast("long").alias("n"))


def slice_quantiles(runs: DataFrame, bounds: DataFrame, series: list[str], probs: list[float]) -> DataFrame:
    """:func:`coded_quantiles` of ``runs``: scope, feature, code, series, value and n. Groups without values are absent."""
    features = sorted(r["feature"] for r in bounds.select("feature").distinct().collect())
    codes = F.array(*[F.when(F.col("feature") == f, F.col("code").cast("int")) for f in features])
    rows = runs.groupBy("scope", *series, "value", codes.alias("codes")).agg(F.sum("n").cast("long").alias("n")).withColumn("bin", F.lit(0))
    rows = materialize(_chunked(rows, ["scope", *series]), "slice-rows")
    counts = materialize(_counts(rows, ["scope", *series], features), "slice-counts")
    return coded_quantiles(rows, counts, bounds, features, series, probs)


def ttc_rows(wide: DataFrame, models: list[str], features: list[str], bounds: DataFrame, horizons: list[float]) -> DataFrame:
    """scope, model (``true`` for the truth), horizon, codes (by feature), value, bin and n: the valid times to collision."""
    last = F.element_at("state", -1)
    front, speed = last[4].cast("double"), F.hypot(last[0].cast("double"), last[2].cast("double"))
    series = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(float(h)).alias("horizon"), window_ttc(front, speed, F.col(f"ax_{m}"), h).alias("value"))
        for m in ["true", *models] for h in horizons])
    valid = F.filter(series, lambda s: s["value"].isNotNull())
    # One row a scope.
    edges = bounds.groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("feature", "edges"))).alias("_edges"))
    rows = wide.withColumn("_series", valid).where(F.size("_series") > 0)
    rows = rows.select(F.explode(F.array(F.lit("all"), F.col("dataset"))).alias("scope"), "_series", *features)
    at = lambda f: F.col("_edges")[f]
    codes = F.array(*[F.when(F.col(f).isNotNull() & at(f).isNotNull(), slices._code(F.col(f), at(f))).cast("int") for f in features])
    rows = rows.join(edges, "scope").select("scope", codes.alias("codes"), F.inline("_series"))
    rows = rows.groupBy("scope", "model", "horizon", "value", "codes").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("bin", ttc.value_bin(F.col("value")))


def slice_ttc(wide: DataFrame, models: list[str], features: list[str], ranges: list[tuple[float, float]], horizons: list[float],
              min_population: int = 20) -> DataFrame:
    """Peak, quantile and combined error of every model on every slice and horizon; the rules are those of ``ttc.error_report``."""
    bounds = materialize(slices._bounds(wide, features, ranges, min_population), "slice-bounds")
    series = ["model", "horizon"]
    rows = materialize(_chunked(ttc_rows(wide, models, features, bounds, horizons), ["scope", *series]), "slice-rows")
    counts = materialize(_counts(rows, ["scope", *series], features), "slice-counts")
    name = ["scope", "feature", "q_lo", "q_hi", "horizon"]
    bins = counts.groupBy("scope", "feature", "code", *series, F.col("bin").cast("int").alias("bin")).agg(F.sum("n").alias("n"))
    binned = slices._over_slices(bins, bounds, [F.sum("n").alias("n")], [*series, "bin"]).drop("value_lo", "value_hi")
    peaks = ttc.peaks_from_counts(binned, [*name, "model"]).select(*name, "model", "peak")
    both = coded_quantiles(rows, counts, bounds, features, series, ttc.QUANTILE_GRID).join(peaks, [*name, "model"])
    truth = both.where("model = 'true'").select(
        *name, F.col("quantiles").alias("_q"), F.col("n").alias("_n"), F.col("peak").alias("_peak"))
    joined = both.where("model <> 'true'").join(truth, name)
    squares = F.aggregate(F.zip_with("quantiles", "_q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    joined = joined.withColumn("n_ttc", F.least("n", "_n")).select(
        *name, "model", "n_ttc", F.abs(F.col("peak") - F.col("_peak")).alias("peak_error"),
        F.when(F.col("n_ttc") >= ttc.MIN_VALUES, F.sqrt(squares / len(ttc.QUANTILE_GRID))).alias("quantile_error"))
    return joined.withColumn("ttc_error", ttc.combined_error(F.col("peak_error"), F.col("quantile_error")))
