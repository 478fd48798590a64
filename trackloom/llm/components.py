"""Connected components of an edge table by alternating large and small stars.

Every round hangs each node's larger (then smaller) neighbours on its smallest one. Minima are combined before the
shuffle and joined back, so a node with very many neighbours is no task of its own: Spark splits a skewed join key. Each
round is written to the shared folder, and the one before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackloom.session import discard, materialize


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = _least(both).select("of", F.least("of", "least").alias("least"))
    return both.where("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = down.join(_least(down), F.col("a") == F.col("of"))
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(joined.select("a", F.col("least").alias("b"))).where("a != b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: two columns of longs. Returns node and root (the component's smallest node) of every node but the roots."""
    now = materialize(edges.toDF("a", "b").where("a != b").distinct(), "stars")
    state = _state(now)
    while True:
        half = materialize(_large_star(now), "stars")
        after = materialize(_small_star(half), "stars")
        discard(now)
        discard(half)
        now, last, state = after, state, _state(after)
        if state == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
