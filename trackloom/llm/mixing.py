"""Mixing sources to target weights with exponential keys, by DataFrame functions alone.

A source's target is its weight's share of all words, stopped at three times what the source holds; what is cut off goes
to the other sources by weight. A target of 2.4 times the source means two complete epochs and a selection of the rest:
every document draws the key ``-ln(u) / weight`` (u from a hash of the row, weight from its quality), the source is read
in key order and documents are taken until the words are used up. The document at the edge is taken if that brings the
sum nearer to the target.

The order within a source is never sorted whole: words are summed per (source, bucket of the key's logarithm) with
map-side combining, a running sum over the buckets finds the one bucket of each source that holds the edge, and only the
rows of that bucket are ordered. Equal rows draw equal keys, so they share a bucket: there they are counted, ordered as one
row, and dealt out again in runs of ``RUN``. A source, or one repeated row, may hold any share of the rows.

Defined results: null text has size 0; a null source is a source of its own, ranked last; a null doc_id or repeated rows
are documents of their own, equal ones drawing equal keys (ties go by doc_id, then text hash). Empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackloom.llm.common import blank_words, fresh, same_row, text_mark
from trackloom.session import materialize

MOST = 3
BUCKETS_PER_DOUBLING = 1024
SEED = 20_240_517
RUN = 10_000


def quality_weight(text: Column) -> Column:
    """Share of letters, digits and blanks among the characters, squared, 0.01 at least; 0.01 for no text."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}\s]+", ""))
    share = F.when(F.length(text) > 0, plain / F.length(text)).otherwise(0.0)
    return F.greatest(F.coalesce(share * share, F.lit(0.0)), F.lit(0.01))


def exponential_key(weight: Column, *identity: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from a seeded hash: the smaller the earlier."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *identity), 12)
    u = (bits.cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def measured(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """One narrow row for each document: doc_id, source, text mark, size, key and the key's bucket."""
    text = F.col("text")
    weight = quality_weight(text) if weight is None else weight
    key = exponential_key(weight, F.col("doc_id"), F.col("text"))
    rows = docs.select("doc_id", "source", text_mark(text).alias("mark"), blank_words(text).alias("size"), key.alias("key"))
    return rows.withColumn("bucket", F.floor(F.log2("key") * BUCKETS_PER_DOUBLING).cast("long"))


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds weight and target; one row for each source, so single-task windows are small.

    In the order of ``most * size / weight``, ``level`` is what a unit of weight gets if all sources before are stopped;
    the first source whose own ratio reaches its level is the first that isn't stopped, and its level is everyone's share.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = F.col("limit") / F.col("weight")
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return (
        sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
        .withColumn("limit", F.col("source_size") * most)
        .withColumn("ratio", ratio)
        .withColumn("stopped", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("left_words", F.sum("source_size").over(everything) - F.col("stopped"))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.col("gone"))
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
        .withColumn("share", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source"))).over(everything))
        .withColumn("target", F.least(F.col("limit").cast("double"), F.coalesce(F.col("weight") * F.col("share"), F.col("limit").cast("double"))))
        .select("source", "source_size", "weight", "target")
    )


def edges(rows: DataFrame, most: int = MOST) -> DataFrame:
    """One row for each source: its target, complete epochs, the bucket that holds the edge, and words left there."""
    by_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    plan = (
        plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumnsRenamed({"source": "plan_source"})
    )
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = by_bucket.withColumn("upto", F.sum("words").over(running)).withColumn("start", F.col("upto") - F.col("words"))
    here = (F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("upto"))
    return (
        upto.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
        .groupBy("plan_source", "source_size", "target", "epochs")
        .agg(
            F.min(F.when(here, F.col("bucket"))).alias("edge"),
            F.min(F.when(here, F.col("rest") - F.col("start"))).alias("edge_words"),
        )
    )


def mix(docs: DataFrame, weight: Column | None = None, most: int = MOST) -> DataFrame:
    """One row for each document row: doc_id, mark, source, size, source_size, target, copies and taken (size * copies)."""
    rows = materialize(measured(docs, weight), "mix-rows")
    plan = materialize(edges(rows, most), "mix-plan")  # written, so its size is known when the join below is planned
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    inside = Window.partitionBy("plan_source").orderBy("key", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = joined.where(F.col("bucket") == F.col("edge")).groupBy(*joined.columns).agg(F.count("*").alias("n"))
    ahead = F.sum(F.col("size") * F.col("n")).over(inside) - F.col("size") * F.col("n")
    room = F.col("edge_words") - F.col("ahead")
    fits = F.when(F.col("size") == 0, F.when(room >= 0, F.col("n")).otherwise(0)).otherwise(F.floor(room / F.col("size") - 0.5) + 1)
    same = same.withColumn("ahead", ahead).withColumn("fit", F.least("n", F.greatest(F.lit(0), fits)).cast("long"))
    # Of n equal rows the first that fit are taken once more; which of them these are makes no difference.
    parts = F.inline(F.array(F.struct(F.lit(1).alias("extra"), F.col("fit").alias("count")), F.struct(F.lit(0).alias("extra"), (F.col("n") - F.col("fit")).alias("count"))))
    runs = same.select(*joined.columns, parts).where("count > 0")
    runs = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / RUN))).alias("run")).repartition("doc_id", "mark", "run")
    at_edge = runs.select(*joined.columns, "extra", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(RUN), F.col("count") - F.col("run") * RUN)))).drop("col")
    # Without an edge the rest is zero, and nothing beyond the complete epochs is taken.
    whole = joined.where(~F.col("bucket").eqNullSafe(F.col("edge"))).withColumn(
        "extra", F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)).cast("int")
    )
    copies = (F.col("epochs") + F.col("extra")).cast("int")
    return whole.unionByName(at_edge).select(
        "doc_id", "mark", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def apply_mix(docs: DataFrame, weight: Column | None = None, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns as given.

    Copies are counted per (doc_id, text mark); equal rows draw equal keys, so only one edge document can differ between
    them, and the larger count then holds for all of them.
    """
    mixed = mix(docs, weight, most)
    own_id, own_mark, own_source, copies, copy = fresh(docs, "mix_id", "mix_mark", "mix_source", "mix_copies", "mix_copy")
    counts = mixed.groupBy(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark), F.col("source").alias(own_source)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    joined = docs.join(counts, same_row(docs, own_id, own_mark) & docs["source"].eqNullSafe(F.col(own_source)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[docs[c] for c in docs.columns])
