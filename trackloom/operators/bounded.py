"""Ordered operators whose work units stay bounded even if one key holds most of the rows.

A plain window over a key puts the whole key into one task. Here every key is cut into chunks of the
order column; each chunk is one work unit, and a small per-chunk summary carries what one chunk needs
to know about the chunks before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK_FRAMES = 2048


def frame_chunk(frame: str = "frame", size: int = CHUNK_FRAMES) -> Column:
    return F.floor(F.col(frame) / F.lit(size)).cast("long")


def _cut(df: DataFrame, chunk: Column) -> DataFrame:
    return df.withColumn("_chunk", chunk)


def totals_before(summary: DataFrame, keys: list[str], totals: list[str], keep: list[str] = ()) -> DataFrame:
    """Per chunk, the sum of each total over the chunks before it."""
    w = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    return summary.select(
        *keys, "_chunk", *keep, *[F.coalesce(F.sum(t).over(w), F.lit(0)).alias(f"{t}_before") for t in totals]
    )


def positions(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column | None = None, name: str = "pos"
) -> DataFrame:
    """0-based row position within ``keys`` in ``order``; ``chunk`` must not decrease along ``order``."""
    parts = _cut(df, chunk if chunk is not None else frame_chunk(order[0]))
    sizes = parts.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    inner = W.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        parts.join(totals_before(sizes, keys, ["_n"]), [*keys, "_chunk"])
        .withColumn(name, (F.row_number().over(inner) - 1 + F.col("_n_before")).cast("long"))
        .drop("_chunk", "_n_before")
    )


def nested_positions(
    df: DataFrame, levels: list[str], order: list[str], chunk: Column, name: str = "pos", within: list[str] = ()
) -> DataFrame:
    """Position over the total order (levels..., order...) without any all-in-one sort.

    Sizes are summed level by level, so each small window covers only the children of one parent.
    """
    within = list(within)
    parts = df.withColumn("_chunk", chunk)
    path = [*within, *levels, "_chunk"]
    sizes = parts.groupBy(*path).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumnRenamed("_n", "_size").withColumn("_base", F.lit(0).cast("long"))
    for depth in range(len(levels), -1, -1):
        parent, child = [*within, *levels[:depth]], [*levels, "_chunk"][depth]
        level = sizes.groupBy(*parent, child).agg(F.sum("_n").alias("_n"))
        w = W.partitionBy(*parent).orderBy(child) if parent else W.partitionBy(F.lit(0)).orderBy(child)
        level = level.select(
            *parent, child,
            F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"),
        )
        offsets = offsets.join(level, [*parent, child]).withColumn("_base", F.col("_base") + F.col("_b")).drop("_b")
    inner = W.partitionBy(*path).orderBy(*order)
    return (
        parts.join(offsets.select(*path, "_base"), path)
        .withColumn(name, (F.row_number().over(inner) - 1 + F.col("_base")).cast("long"))
        .drop("_chunk", "_base")
    )


def running_sums(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], chunk: Column | None = None
) -> DataFrame:
    """Inclusive running sums within ``keys`` along ``order``."""
    for name, value in sums.items():
        df = df.withColumn(f"_in_{name}", value)
    parts = _cut(df, chunk if chunk is not None else frame_chunk(order[0]))
    totals = parts.groupBy(*keys, "_chunk").agg(*[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums])
    inner = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = parts.join(totals_before(totals, keys, [f"_t_{n}" for n in sums]), [*keys, "_chunk"])
    out = out.withColumns(
        {n: F.coalesce(F.sum(f"_in_{n}").over(inner), F.lit(0)) + F.col(f"_t_{n}_before") for n in sums}
    )
    return out.drop("_chunk", *[f"_in_{n}" for n in sums], *[f"_t_{n}_before" for n in sums])


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str],
    chunk: Column | None = None, forward: bool = False,
) -> DataFrame:
    """Columns of the previous (or next) row within ``keys`` along ``order``; null at the end."""
    parts = _cut(df, chunk if chunk is not None else frame_chunk(order[0]))
    fields = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    edge = F.min_by if forward else F.max_by
    # Number by number: an aggregate that holds whole structs is made by sorting all rows.
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    tails = parts.groupBy(*keys, "_chunk").agg(F.struct(*[edge(F.col(src), place).alias(new) for new, src in columns.items()]).alias("_edge"))
    outer = W.partitionBy(*keys).orderBy("_chunk")
    shift = F.lead if forward else F.lag
    tails = tails.select(*keys, "_chunk", shift("_edge").over(outer).alias("_edge"))
    inner = W.partitionBy(*keys, "_chunk").orderBy(*order)
    out = parts.join(tails, [*keys, "_chunk"]).withColumn("_near", shift(fields).over(inner))
    out = out.withColumns({new: F.coalesce(F.col("_near"), F.col("_edge"))[new] for new in columns})
    return out.drop("_chunk", "_edge", "_near")


def with_halo(df: DataFrame, order: str, before: int, after: int, size: int = CHUNK_FRAMES) -> DataFrame:
    """Cut by ``order`` into chunks and copy edge rows so each chunk also sees its surroundings.

    Adds ``_chunk`` and ``_own`` (false on copies). ``before``/``after`` are in units of ``order`` and must
    not exceed ``size``.
    """
    if max(before, after) > size:
        raise ValueError("halo wider than a chunk")
    c = frame_chunk(order, size)
    inside = F.col(order) - c * size
    homes = F.filter(
        F.array(
            F.when(inside < after, c - 1),
            c,
            F.when(inside >= size - before, c + 1),
        ),
        lambda x: x.isNotNull(),
    )
    return df.withColumn("_home", c).withColumn("_chunk", F.explode(homes)).withColumn(
        "_own", F.col("_chunk") == F.col("_home")
    ).drop("_home")


def _bucket(v: Column) -> Column:
    # Order-preserving and scale-free; every step is monotone in double arithmetic.
    return F.floor(F.signum(v) * F.asinh(F.abs(v) * 1000.0) * 256.0).cast("long")


def quantiles(
    df: DataFrame, group: list[str], value: Column, probs: list[float], name: str = "quantiles", weight: Column | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles per group as an array aligned with ``probs``; a row counts ``weight`` times.

    A histogram (combined before the shuffle) locates the buckets that hold the wanted ranks; only rows of
    those buckets are ranked. Nulls and NaN are ignored; groups without values are absent.
    """
    weight = F.lit(1) if weight is None else weight
    vals = df.select(*group, value.cast("double").alias("_v"), weight.cast("long").alias("_w")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    vals = vals.withColumn("_b", _bucket(F.col("_v")))
    hist = vals.groupBy(*group, "_b").agg(F.sum("_w").alias("_n"))
    scope = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    below = scope.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    hist = hist.withColumn("_lo", F.coalesce(F.sum("_n").over(below), F.lit(0))).withColumn(
        "_total", F.sum("_n").over(scope)
    )
    plist = F.array(*[F.lit(float(p)) for p in probs])
    ranks = F.flatten(
        F.transform(
            plist,
            lambda p, i: F.array(
                F.struct(i.alias("i"), F.lit(0).alias("side"), F.floor(p * (F.col("_total") - 1)).alias("rank")),
                F.struct(i.alias("i"), F.lit(1).alias("side"), F.ceil(p * (F.col("_total") - 1)).alias("rank")),
            ),
        )
    )
    wanted = F.filter(ranks, lambda r: (r["rank"] >= F.col("_lo")) & (r["rank"] < F.col("_lo") + F.col("_n")))
    hits = hist.select(*group, "_b", "_lo", "_total", wanted.alias("_want")).where(F.size("_want") > 0)
    rows = vals.join(hits.select(*group, "_b"), [*group, "_b"], "left_semi")
    rows = rows.groupBy(*group, "_b", "_v").agg(F.sum("_w").alias("_c"))
    inner = W.partitionBy(*group, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(hits, [*group, "_b"]).withColumn("_at", F.col("_lo") + F.coalesce(F.sum("_c").over(inner), F.lit(0)))
    picked = rows.select(
        *group, "_v", "_total",
        F.explode(
            F.filter("_want", lambda r: (r["rank"] >= F.col("_at")) & (r["rank"] < F.col("_at") + F.col("_c")))
        ).alias("_r"),
    )
    per_prob = picked.groupBy(*group, F.col("_r.i").alias("_i")).agg(
        F.max(F.when(F.col("_r.side") == 0, F.col("_v"))).alias("_a"),
        F.max(F.when(F.col("_r.side") == 1, F.col("_v"))).alias("_z"),
        F.max("_total").alias("_total"),
    )
    at = F.element_at(plist, (F.col("_i") + 1).cast("int")) * (F.col("_total") - 1)
    per_prob = per_prob.withColumn("_q", F.col("_a") + (F.col("_z") - F.col("_a")) * (at - F.floor(at)))
    return per_prob.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias(name),
        F.max("_total").alias(f"{name}_n"),
    )


def quantile_columns(
    df: DataFrame, group: list[str], value: Column, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles as named columns."""
    out = quantiles(df, group, value, list(probs.values()), "_qs")
    return out.select(*group, *[F.get("_qs", F.lit(i)).alias(n) for i, n in enumerate(probs)])


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per group. Rows are trimmed per salt first, so a group's final ranking sees at most 64 n of them."""
    salted = W.partitionBy(*group, "_salt").orderBy(*order)
    df = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    df = df.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= n).drop("_r", "_salt")
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
