import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import oracle
import pytest
from conftest import FOLDER

from trackloom.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    turns = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    for c, ts in turns.items():
        h = crc32(str(c).encode()) % 4
        whole = turns.get(c - c % 20, [])[:h] + ts[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, len(whole) == d))
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for way in members:
        if way:
            children[way[:-1]] += 1
    for way, of in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", way[-1][1])) if way else 0
        for d in range(len(way) + 1):
            leaves[way[:d]] += way not in children
            saved[way[:d]] += (len(of) - 1) * words
    least = {way: min(c for c, _ in of) for way, of in members.items()}
    return sorted((
        least[way], len(way), least[way[:-1]] if way else None, len(of), children.get(way, 0), leaves[way], saved[way],
        hashlib.sha256(",".join(str(c) for c, end in sorted(of) if end).encode()).hexdigest()) for way, of in members.items())


def found(spark, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, schema)).select(*COLUMNS).collect()), key=lambda r: (r[0], r[1]))


def made_up(seed, convs, texts, most):
    """Conversations over few texts, so that they share first turns, and many are equal."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(convs * 2), convs):
        for t in range(rng.randrange(1, most)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "user", f"text {'w ' * rng.randrange(texts)}"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cells, texts", [(1, 2), (40, 5), (10**6, 1)])
def test_against_plain(spark, monkeypatch, cells, texts):
    """Blocks of one row, of a few and of a whole partition combine to the same nodes."""
    monkeypatch.setattr(prefix_trie, "CELLS", cells)
    rows = made_up(cells + texts, 150, texts, 7)
    assert found(spark, rows) == plain(rows)


def test_equal_conversations(spark, monkeypatch):
    """A third of all conversations are one sequence, another third starts with it."""
    monkeypatch.setattr(prefix_trie, "CELLS", 50)
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(6)]
    rows += [(c, t, "user", f"turn {t}" if t < 6 else f"own {c % 7}") for c in range(1000, 1300) for t in range(9)]
    rows += [(c, 0, "user", f"only {c}") for c in range(2000, 2300)]
    assert found(spark, rows) == plain(rows)


def test_long_conversation(spark):
    rows = [(c, t, "user", f"t{t % 3}") for c in (40, 41, 47) for t in range(3000 if c == 40 else 5)]
    assert found(spark, rows) == plain(rows)


ODD = [
    (20, None, "user", "first"), (20, 0, None, "second"), (20, 1, "user", None), (20, 1, "user", None), (21, 5, "a", "tie"), (21, 5, "b", "tie"), (21, 5, "a", "other"),
    (22, None, None, None), (None, 1, "user", "of no conversation"), (23, 1, "ab", "c"), (24, 1, "a", "bc"), (25, 1, "", " \t\n "), (26, 0, "user", "w " * 50_000),
    (-3, 0, "user", "first"), (60, 0, "user", "x"), (60, 0, "user", "x"), (6000, 0, "é😀", "漢"),
]


def test_odd_rows(spark):
    odd = [(*r, "x", "x") for r in ODD]
    by_rem = [r for r in ODD if r[0] is None or r[0] >= 0]  # the sign of c % 20 differs between the languages
    assert found(spark, [(*r, "x", "x") for r in by_rem], SCHEMA + ", path string, N string") == plain(by_rem)
    assert len(found(spark, odd, SCHEMA + ", path string, N string")) >= len(plain(by_rem))
    assert found(spark, ODD[8:9]) == [] and found(spark, []) == []


def test_negative_ids(spark):
    rows = [(-20, 0, "u", "head 0"), (-20, 1, "u", "head 1"), (-20, 2, "u", "head 2"), (-23, 0, "u", "a"), (-23, 1, "u", "b"), (-23, 2, "u", "c"), (-23, 3, "u", "d")]
    h = crc32(b"-23") % 4
    one = [r for r in found(spark, rows) if r[1] > h and r[3] == 1]
    assert one and all(r[0] in (-20, -23) for r in one)


def test_query(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CELLS", 30)
    same, message = oracle.compare(queries.op13_prefix_trie(spark, FOLDER), oracle.connect(FOLDER), queries.SQL["op13_prefix_trie"])
    assert same, message
