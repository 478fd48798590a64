"""URL filter: exact membership of url keys in lists by a cascade of Bloom filters.

A rule is a host and a path prefix; its key is the two joined. A url has one candidate key for each parent domain of its
host and each path length that occurs in the rules. The universe is the set of all candidate keys of the corpus. Level 0
of a cascade encodes the listed keys; level 1 those unlisted keys of the universe that level 0 lets through; level 2 the
listed ones that level 1 lets through, and so on until nothing is left. The first level that rejects a key then tells
exactly whether it is listed, for every key of the universe, so judging a url needs no join: the filters are broadcast.

Filters are built by tasks (bits are combined before the shuffle) and only their words reach the driver. Their size is
proportional to the list, checked against ``MOST_BITS``; a longer list is looked up by an equi-join of keys instead.

Defined results: a null url, or one without ``://``, has empty host and path; no rule fits then unless a rule is empty.
Without a fitting rule a url is blocked if its host or a parent of it is on the host list, else allowed. Repeated rows
are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trackloom.llm.common import ascii_lower
from trackloom.session import materialize

# host, path, verdict
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
# Hosts of the corpus with such a label, or such a part of a label between hyphens, make up the host list.
LISTED_LABELS = ["spam", "casino", "adult", "malware", "phishing"]
MOST_BITS = 1 << 29  # 64 MB
FIRST_BITS, LATER_BITS = 10, 3  # bits for each key
MOST_LEVELS = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)([^?#]*)", i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def parents(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Keys of the rules that could fit, longest first (the longer host first among equal lengths)."""
    prefixes = F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(path_lengths), reverse=True)])
    pairs = F.flatten(F.transform(parents(host), lambda h: F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.struct(
        (-F.char_length(h) - F.char_length(p)).alias("order"), (-F.char_length(h)).alias("host_order"), F.concat(h, p).alias("key")))))
    return F.transform(F.array_sort(pairs), lambda x: x["key"])


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.xxhash64(F.lit(7), key)]


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, k: int, bits: int) -> np.ndarray:
    """k bit positions for each key, one row per hash function."""
    a, b = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
    out = np.empty((k, len(a)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            x = a + b * np.uint64(level * 31 + i + 1)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out[i] = (x ^ (x >> np.uint64(32))) % np.uint64(bits)
    return out


@dataclass(frozen=True)
class Level:
    bits: int
    k: int
    words: np.ndarray

    def holds(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        at = _positions(h1, h2, level, self.k, self.bits)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def member(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed. Levels of even number hold listed keys."""
    out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
    for i, level in enumerate(levels):
        passed = level.holds(h1[open_], h2[open_], i)
        out[open_[~passed]] = i % 2 == 1
        open_ = open_[passed]
    out[open_] = len(levels) % 2 == 1
    return out


def build_level(keys: DataFrame, count: int, number: int) -> Level:
    """One filter over the rows (h1, h2) of ``keys``."""
    per_key = FIRST_BITS if number == 0 else LATER_BITS
    bits, k = max(64, -(-count * per_key // 64) * 64), max(1, round(per_key * 0.69))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_positions(b.column(0).to_numpy(), b.column(1).to_numpy(), number, k, bits))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], ["word", "value"])

    table = np.zeros(bits // 64, np.uint64)
    for r in keys.select("h1", "h2").mapInArrow(words, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toLocalIterator():
        table[r["word"]] = np.int64(r["value"]).view(np.uint64)
    return Level(bits, k, table)


def _passing(keys: DataFrame, level: Level, number: int) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(level.holds(b.column(0).to_numpy(), b.column(1).to_numpy(), number)))

    return keys.mapInArrow(keep, "h1 long, h2 long")


def build_cascade(listed: DataFrame, others: DataFrame) -> list[Level]:
    """listed, others: disjoint sets of keys as rows (h1, h2). Raises if a filter would pass ``MOST_BITS``."""
    levels: list[Level] = []
    now, other = listed.select("h1", "h2"), others.select("h1", "h2")
    while count := now.count():
        if len(levels) == MOST_LEVELS or count * FIRST_BITS > MOST_BITS:
            raise ValueError(f"a cascade over {count} keys at level {len(levels)} does not fit the broadcast bound")
        levels.append(build_level(now, count, len(levels)))
        now, other = materialize(_passing(other, levels[-1], len(levels) - 1), "cascade"), now
    return levels


def universe(pages: DataFrame, rules: DataFrame, hosts: DataFrame, lengths: list[int]) -> DataFrame:
    """All candidate keys and host keys of the corpus, once each: h1, h2 and the list that holds them (or null).

    Urls are reduced to distinct (host, path prefix) before their keys are made, so hot hosts cost one row each.
    """
    host, path = host_and_path(F.col("url"))
    longest = max(lengths, default=0)
    short = pages.select(host.alias("host"), F.substring(path, 1, longest).alias("path")).distinct()
    keys = short.select(F.explode(F.array_union(
        F.transform(candidate_keys(F.col("host"), F.col("path"), lengths), lambda k: F.struct(F.lit("rule").alias("kind"), k.alias("key"))),
        F.transform(parents(F.col("host")), lambda k: F.struct(F.lit("host").alias("kind"), k.alias("key"))),
    )).alias("k")).select("k.kind", "k.key").distinct()
    listed = rules.select(F.lit("rule").alias("kind"), "key", F.col("verdict").alias("list")).unionByName(
        hosts.select(F.lit("host").alias("kind"), F.col("host").alias("key"), F.lit("listed").alias("list"))
    )
    h1, h2 = hashes(F.concat_ws(" ", "kind", "key"))
    return keys.join(listed, ["kind", "key"], "left").select(h1.alias("h1"), h2.alias("h2"), "kind", "key", "list")


def listed_hosts(pages: DataFrame, labels: list[str] = LISTED_LABELS) -> DataFrame:
    host, _ = host_and_path(F.col("url"))
    parts = F.split(F.col("host"), r"[.-]")
    return pages.select(host.alias("host")).distinct().where(F.arrays_overlap(parts, F.array(*map(F.lit, labels))))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(h + p, v) for h, p, v in rules], "key string, verdict string")


def judge(pages: DataFrame, rules=RULES, hosts: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url")
    hosts = listed_hosts(pages) if hosts is None else hosts
    lengths = [len(p) for _, p, _ in rules]
    everything = materialize(universe(pages, rule_table(spark, rules), hosts, lengths), "universe")
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths)).withColumn("parents", parents(F.col("host")))
    counts = everything.groupBy("list").count().where("list is not null").collect()  # three rows at most
    if max([0, *(r["count"] for r in counts)]) * FIRST_BITS > MOST_BITS:
        return _by_join(rows, everything)
    split = lambda name: build_cascade(everything.where(F.col("list") == name), everything.where(~F.col("list").eqNullSafe(F.lit(name))))
    allow, block, listed = (spark.sparkContext.broadcast(split(n)) for n in ("allow", "block", "listed"))

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = lambda b, name: b.column(name).flatten().to_numpy()
        for b in batches:
            n, row = b.num_rows, np.repeat(np.arange(b.num_rows), np.asarray(b.column("k1").value_lengths()))
            h1, h2 = flat(b, "k1"), flat(b, "k2")
            allowed, blocked = member(allow.value, h1, h2), member(block.value, h1, h2)
            hit = np.flatnonzero(allowed | blocked)
            which, first = np.unique(row[hit], return_index=True)
            first = hit[first]
            start = np.concatenate(([0], np.cumsum(np.asarray(b.column("k1").value_lengths()))))
            place, verdict = np.zeros(n, np.int32), np.full(n, "allow", object)
            place[which] = first - start[which] + 1
            owner = np.repeat(np.arange(n), np.asarray(b.column("p1").value_lengths()))
            verdict[owner[member(listed.value, flat(b, "p1"), flat(b, "p2"))]] = "block"
            verdict[which] = np.where(blocked[first], "block", "allow")
            rule = [keys[p - 1].as_py() if p else None for keys, p in zip(b.column("keys"), place)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    hashed = lambda name, i, kind: F.transform(name, lambda k: hashes(F.concat_ws(" ", F.lit(kind), k))[i])
    ready = rows.select(
        F.col("page_id").cast("long").alias("page_id"), "host", "path", "keys", hashed("keys", 0, "rule").alias("k1"), hashed("keys", 1, "rule").alias("k2"),
        hashed("parents", 0, "host").alias("p1"), hashed("parents", 1, "host").alias("p2"),
    )
    return ready.mapInArrow(verdicts, "page_id long, host string, path string, rule string, verdict string")


def _by_join(rows: DataFrame, everything: DataFrame) -> DataFrame:
    """For lists too long to broadcast: the same answer by joining each key with the lists."""
    listed = everything.where("list is not null").select("kind", "key", "list")
    exploded = rows.withColumn("row", F.struct("page_id", "host", "path")).withColumn("url_id", F.monotonically_increasing_id())
    exploded = materialize(exploded, "url-rows")
    keys = exploded.select("url_id", F.posexplode("keys").alias("i", "key")).withColumn("kind", F.lit("rule")).unionByName(
        exploded.select("url_id", F.posexplode("parents").alias("i", "key")).withColumn("kind", F.lit("host")))
    best = keys.join(listed, ["kind", "key"]).groupBy("url_id").agg(
        F.min(F.when(F.col("kind") == "rule", F.struct("i", "key", "list"))).alias("fit"), F.max(F.col("kind") == "host").alias("on_list"))
    verdict = F.coalesce(F.col("fit.list"), F.when(F.col("on_list"), "block"), F.lit("allow"))
    return exploded.join(best, "url_id", "left").select(F.col("page_id").cast("long").alias("page_id"), "host", "path", F.col("fit.key").alias("rule"), verdict.alias("verdict"))
