import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from conftest import FOLDER, ODD_ROWS
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from trackloom.llm import merge_encoding as merges, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
PIECES = merges.load(PATH)
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    out = []
    for doc, text in rows:
        ids = MODEL.encode(text or "")
        out.append((doc, len(ids), sha(",".join(map(str, ids))), sha(MODEL.decode(ids))))
    return sorted(out, key=repr)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\n\tabeinorst=-0"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_like_the_library(text):
    ids = MODEL.encode(text)
    assert list(PIECES.encode(text)) == ids and PIECES.decode(ids) == MODEL.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 260), st.integers(0, 31_999)), max_size=12))
def test_any_ids(ids):
    assert PIECES.decode(ids) == MODEL.decode(ids)


def test_pairs_merge_back():
    """The quick check of a pair against merging the joined text."""
    rng, known = random.Random(2), sorted(PIECES.yielded)
    for _ in range(20_000):
        a, b = rng.choice(known), rng.choice(known)
        assert PIECES._merges_back(a, b) == (PIECES.merge(PIECES.names[a] + PIECES.names[b]) == [PIECES.names[a], PIECES.names[b]])


@pytest.mark.parametrize("text", ["x" * 5000, " " * 3000, "ab" * 3000, "the  end " * 2000, "é漢😀\x00" * 500, "▁ ▁▁ " * 300])
@pytest.mark.parametrize("part", [7, 1000])
def test_long_and_in_parts(monkeypatch, text, part):
    monkeypatch.setattr(merges, "PART", part)
    monkeypatch.setattr(merges, "KEPT_WORDS", 3)
    assert list(PIECES.encode(text)) == MODEL.encode(text)


def test_odd_rows(spark, odd, none):
    found = merges.digests(odd, PIECES).collect()
    assert sorted(map(tuple, found), key=repr) == expected([r[:2] for r in ODD_ROWS])
    assert not merges.digests(none, PIECES).collect()


def test_round_trip(spark, odd):
    """Columns of other names stay, one named like the result is replaced."""
    docs = odd.withColumn("IDS", F.lit("x"))
    back = merges.decode(merges.encode(docs, PIECES), PIECES)
    assert back.columns == odd.columns + ["ids", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect())
    none_at_all = spark.createDataFrame([(1, None), (2, [None, 5, -1, 99_999_999])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in merges.decode(none_at_all, PIECES).orderBy("doc_id").collect()] == ["", MODEL.decode([5])]


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op11_merge_encoding(spark, FOLDER).collect()), key=repr) == expected([tuple(r) for r in docs])


def test_other_models():
    with pytest.raises(Exception):
        merges.load(public_tokenizers.path("byte_bpe_50k.json"))


def test_remembered_words_cost_one_lookup(monkeypatch):
    """The second time a text's words are joined without a call for each of them; a new one is encoded alone."""
    text = "the  remembered words " * 50
    ids = MODEL.encode(text)
    assert list(PIECES.encode(text)) == ids
    asked = []
    remembered = merges.Pieces._ids_of
    monkeypatch.setattr(merges.Pieces, "_ids_of", lambda self, word: asked.append(word) or remembered(self, word))
    assert list(PIECES.encode(text)) == ids and not asked
    assert list(PIECES.encode(text + "qzxjv")) == MODEL.encode(text + "qzxjv") and asked == ["▁qzxjv"]


def test_longest_piece_comes_first():
    """What backtracking starts from at each place is the longest piece there."""
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["ing", "the", "er", "a", "on", "s", "tion", merges.BLANK]) for _ in range(8))
        first = {}
        for last, i in PIECES._automaton.iter(text[::-1]):
            first.setdefault(last, i)
        for last, i in PIECES._automaton.iter(text[::-1]):
            assert len(PIECES.names[i]) <= len(PIECES.names[first[last]])


def test_words_share_what_is_remembered_whatever_follows():
    """Letters and signs that no piece joins are encoded apart, with the library's ids."""
    pieces = merges.load(PATH)
    pieces._words.clear()
    text = "walking, walking. (walking) walking!!! 12walking; walking\nwalking 据数walking’s ##a"
    assert list(pieces.encode(text)) == MODEL.encode(text)
    assert sum("walking" in word for word in pieces._words) == 2
