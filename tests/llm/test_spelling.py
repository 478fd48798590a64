import random
import re
from collections import Counter
from zlib import crc32

import oracle
import pytest
from conftest import FOLDER, ODD_ROWS

from trackloom.llm import queries, spelling

LOWER = {i: i + 32 for i in range(65, 91)}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, root, form[w], n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def found(spark, docs):
    df = docs if hasattr(docs, "columns") else spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(tuple(r) for r in spelling.variants(df).select("word", "root", "form", "n", "n_near", "form_n").collect())


def made_up(seed, letters, lengths, texts=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(12)]
    words = list(base)
    for w in base * 3:
        i = rng.randrange(len(w))
        words.append(w[:i] + rng.choice(["", rng.choice(letters), w[i] + rng.choice(letters)]) + w[i + 1 :])
    weights = [rng.choice([1, 3, 40, 500]) for _ in words]
    return [(i, " ".join(rng.choices(words, weights, k=80))) for i in range(texts)]


@pytest.mark.parametrize("letters, lengths", [("ab", [7, 8, 9]), ("abcdeéßÿÀ×", [7, 8, 12]), ("aeinst", [46, 47, 48, 49, 50, 51]), ("az", [100, 400])])
def test_against_plain(spark, letters, lengths):
    docs = made_up(len(letters), letters, lengths)
    assert found(spark, docs) == plain(docs)


@pytest.mark.parametrize("symbols", [2, 4, 30])
def test_any_alphabet(spark, monkeypatch, symbols):
    """How many symbols letters are reduced to changes no row."""
    monkeypatch.setattr(spelling, "symbols_for", lambda words: {n: max(2, symbols + n % 3) for n in range(1, spelling.LONG + 2)})
    docs = made_up(5, "abcdefgh", [7, 8, 9, 20])
    assert found(spark, docs) == plain(docs)


def test_chains_and_ties(spark):
    """Forms of forms; equal n; words whose letters share symbols; a vowel run."""
    counts = {"abcdefgh": 4000, "abcdefgx": 400, "abcdefyx": 40, "abcdezyx": 3, "qqqqqqqa": 30, "qqqqqqqb": 30, "qqqqqqqc": 2, "aaaaaaa": 25, "aaaaaaaa": 2}
    docs = [(31 * i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())]
    got = found(spark, docs)
    assert got == plain(docs)
    assert {r[0]: r[1] for r in got}.get("abcdezyx") == "abcdefgh"


def test_parts(spark, monkeypatch):
    docs = made_up(9, "abc", [7, 8])
    monkeypatch.setattr(spelling, "PART", 50)
    monkeypatch.setattr(spelling, "HELD", 3)
    assert list("".join(spelling._text_parts("ab cd" * 99))) == list("ab cd" * 99)
    assert found(spark, docs) == plain(docs)


def test_odd_rows(spark, odd, none):
    assert found(spark, odd) == plain([r[:2] for r in ODD_ROWS])
    assert found(spark, none) == []


def test_query(spark):
    same, message = oracle.compare(queries.op12_spelling_variants(spark, FOLDER), oracle.connect(FOLDER), queries.SQL["op12_spelling_variants"])
    assert same, message
