"""Small helpers shared by the training-data operators: row identity, words, free column names."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Bytes that numeric code inside a task looks at together; bounds its memory whatever the batch holds.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_mark(text: Column) -> Column:
    """Tells apart rows that repeat a doc_id with another text; equal rows share it. Null counts as no text."""
    return F.xxhash64(text)


def pieces(text: Column, separators: str) -> tuple[Column, Column]:
    """The text split at runs of separators, and how many non-empty pieces that gives.

    Only the first and last piece can be empty, so positions in the array are word positions up to a shift.
    """
    parts = F.split(F.coalesce(text, F.lit("")), separators)
    count = F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - (
        (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
    ).cast("int")
    return parts, count.cast("long")


def blank_words(text: Column) -> Column:
    """Number of runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names built from ``names`` that ``df`` does not use in any case."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def same_row(df: DataFrame, id_name: str, mark_name: str) -> Column:
    """Join condition between a document row and columns that hold its doc_id and text mark."""
    return df["doc_id"].eqNullSafe(F.col(id_name)) & text_mark(df["text"]).eqNullSafe(F.col(mark_name))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch in one array, and where each text starts (one entry more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if not len(column) or column.buffers()[2] is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def spans_of_rows(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` bytes together; a longer text stands alone."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield first, last
        first = last
