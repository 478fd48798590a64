"""Query registry: a name, a Spark callable, and the equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def plain_types(df: DataFrame) -> DataFrame:
    """Integers as bigint, so that both engines agree on the result type."""
    narrow = [f.name for f in df.schema.fields if f.dataType.typeName() in {"integer", "short", "byte"}]
    return df.withColumns({n: F.col(n).cast("long") for n in narrow}) if narrow else df


def query(covers: str, sql: str | None = None):
    """Register the decorated function under its own name; ``covers`` lists survey ids."""

    def add(fn):
        if fn.__name__ in QUERIES:
            raise ValueError(f"duplicate query {fn.__name__}")
        QUERIES[fn.__name__] = Query(fn.__name__, lambda spark, folder: plain_types(fn(spark, folder)), sql, tuple(covers.split()))
        return fn

    return add


def with_blocks(body: str, *blocks: str) -> str:
    return "WITH " + ",".join(b.strip() for b in blocks) + "\n" + body


def r(value: Column | str, places: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c, places) + F.lit(0.0)


def rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, places) for c in columns})
