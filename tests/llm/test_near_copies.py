import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from conftest import FOLDER

from trackloom.llm import near_copies
from trackloom.llm.common import table


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept(docs):
    """docs: (doc_id, text), all pairs compared. The smallest doc_id of each component."""
    sets, least = [shingle_set(t) for _, t in docs], {d: d for d, _ in docs}
    root = lambda d: d if least[d] == d else root(least[d])
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * 5 >= len(a | sets[j]) * 4:
                x, y = sorted((root(docs[i][0]), root(docs[j][0])))
                least[y] = x
    return sorted({root(d) for d in least})


def edited(seed=3, each=40):
    """Texts of 50 to 500 words and a copy of each with one word in about 60 changed. doc_id of a copy: 10,000 more."""
    rng, out = random.Random(seed), []
    for n in (50, 100, 200, 500):
        for _ in range(each):
            words = [f"w{rng.randrange(5000)}" for _ in range(n)]
            copy = list(words)
            for at in rng.sample(range(n), max(1, n // 60)):
                copy[at] = f"new{rng.randrange(10**6)}"
            out.append((len(out) // 2, n, " ".join(words)))
            out.append((10_000 + len(out) // 2, n, " ".join(copy)))
    return out


def stage(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(d for d, in corpus_pipeline.near_copies(spark, df, FOLDER).select("doc_id").collect())


def test_edited_copies_go(spark):
    docs = edited()
    found = set(stage(spark, [(d, t) for d, _, t in docs]))
    truth = {d: t for d, _, t in docs}
    lost, of = defaultdict(int), defaultdict(int)
    for d, n, t in docs:
        if d >= 10_000:
            a, b = shingle_set(t), shingle_set(truth[d - 10_000])
            assert len(a & b) / len(a | b) >= 0.8
            of[n], lost[n] = of[n] + 1, lost[n] + (d in found)
    print({n: (of[n] - lost[n], of[n]) for n in of})
    assert not any(lost.values()) and {d for d, *_ in docs if d < 10_000} <= found


def test_stage_is_jaccard(spark):
    docs = [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    assert stage(spark, docs) == kept(docs)


def test_groups_of_many(spark):
    """Chains, a large group of near copies, texts that share much but too little, and short ones."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(120)]
    near = [(i, " ".join(w if rng.random() > 0.01 else f"n{rng.randrange(10**6)}" for w in base)) for i in range(150)]
    half = [(1000 + i, " ".join(base[:60] + [f"h{i}x{k}" for k in range(60)])) for i in range(30)]
    chain = [(2000 + i, " ".join(f"c{k}" for k in range(4 * i, 4 * i + 100))) for i in range(12)]
    short = [(3000, "A b"), (3001, "a  B"), (3002, "a b c"), (3003, None), (3004, " \n"), (3005, "")]
    docs = near + half + chain + short
    assert stage(spark, docs) == kept(docs)


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_band_keys(n):
    """A long set is read in parts."""
    hashes = np.random.default_rng(n).integers(0, 1 << 64, n, np.uint64)
    whole = near_copies.band_keys(hashes)
    assert len(whole) == near_copies.BANDS and (near_copies.band_keys(hashes[::-1]) == whole).all()


def boilerplate(pairs=300, seed=5):
    """Texts that share most of their words with all others (Jaccard below 0.8) and a little more with one of them."""
    rng = random.Random(seed)
    shared, out = [f"s{i}" for i in range(400)], []
    for i in range(pairs):
        own = [f"o{i}x{k}" for k in range(18)]
        for side in (0, 1):
            out.append((2 * i + side, " ".join(shared + own + [f"e{i}x{side}x{k}" for k in range(42)])))
    rng.shuffle(out)
    return out


def test_boilerplate_loses_no_pair(spark):
    """All texts share large buckets with all others, and each is similar to one of them only."""
    docs = boilerplate()
    a, b, c = (shingle_set(dict(docs)[i]) for i in (0, 1, 2))
    assert len(a & c) / len(a | c) < 0.8 <= len(a & b) / len(a | b) < 0.85
    assert stage(spark, docs) == [2 * i for i in range(300)]


@pytest.mark.parametrize("together", [4, 4096])
def test_common_counts(monkeypatch, together):
    monkeypatch.setattr(near_copies, "TOGETHER", together)
    rng = np.random.default_rng(1)
    sides = [[np.unique(rng.integers(0, 40, n)) for n in sizes] for sizes in ((0, 5, 30, 1), (7, 0, 25))]
    lists = [x for s in sides for x in (np.cumsum([len(v) for v in s]), np.concatenate(s))]
    assert near_copies.common_counts(*lists).tolist() == [[len(set(x) & set(y)) for y in sides[1]] for x in sides[0]]
    assert near_copies.common_counts(lists[0], lists[1], np.array([0]), np.zeros(0, np.int64)).tolist() == [[0]] * 4


def test_blocks_of_many_components(spark, monkeypatch):
    """Blocks small enough that components, classes of size and rests of a bucket are dealt apart; the same documents stay."""
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    monkeypatch.setattr(near_copies, "BLOCK_HASHES", 2000)
    rng = random.Random(8)
    base, docs = [f"b{i}" for i in range(200)], []
    for i in range(160):
        edits = rng.choice((1, 3, 5, 8))
        words = base[: rng.choice((200, 190, 165))]
        for at in rng.sample(range(len(words)), edits):
            words[at] = f"n{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    assert stage(spark, docs) == kept(docs)
