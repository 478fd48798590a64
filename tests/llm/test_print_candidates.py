"""The near-copy stage proposes pairs by the bit-sliced comparison of fingerprints; similarity of the texts decides."""

import random

from trackloom.llm import near_copies, simhash


def test_near_prints_are_candidates(spark):
    rows = [(1, 10, 0b0, 1), (2, 10, 0b0, 2), (3, 10, 0b11, 3), (4, 10, 0b11111, 4), (5, 0, 0b0, 5), (6, 100, 0b0, 6)]
    nodes = spark.createDataFrame(rows, "node long, size long, fp long, root long")
    got = {(r["a"], r["b"]) for r in near_copies.print_candidates(nodes).collect()}
    # 4 is three bits away from its nearest, 5 has no words, 6 is much larger.
    assert got == {(1, 2), (1, 3)}


def test_stage_links_by_prints(spark, monkeypatch):
    """Without any band the copies that two bits link are still found, and only where their texts are similar."""
    rng = random.Random(0)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    changed = [*words[:300], "other", *words[301:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, "some quite different text of words")], "doc_id long, text string")
    prints = [simhash.fingerprint(" ".join(w).encode()) for w in (words, changed)]
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.RADIUS
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(near_copies, "first_candidates", lambda nodes: none)
    monkeypatch.setattr(near_copies, "small_candidates", lambda opened: none)
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == [1, 3]
