"""Benchmark decontamination by a positional inverted index, in DataFrame functions alone.

The index holds postings (term, document, position) of training tokens, written to the shared folder in runs sorted by
term. A test item is cut into windows of ten consecutive words. How often each test term occurs in training is counted
first; a window is then looked up by its two rarest terms: the postings of the rarest give alignments (position less the
term's offset in the window), which are intersected with the postings of the second rarest at its own offset. What is left
is compared word by word with the document. A lookup therefore costs as much as its rarest terms occur, and only the lists
that some window asks for need to be in the index (``build_index`` without terms stores all).

Term lists meet documents by joins whose small side is written first, so that Spark broadcasts it only when its size is
below the threshold and otherwise shuffles with skewed keys split. A posting list of any length is many rows, not one.

Words are maximal runs of letters a-z (A-Z lower-cased), digits and characters beyond ASCII. Defined results: null text
has no words; an item of fewer than ten words, but not none, is one window; items without words or with a null item_id
match nothing; items with equal windows all count; rows that repeat a doc_id are told apart by their text, and equal rows
get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackloom.llm.common import ascii_lower, fresh, pieces, same_row, text_mark
from trackloom.session import materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
RUN = ["term", "doc_id", "mark", "pos"]


def word_pieces(text: Column) -> tuple[Column, Column]:
    return pieces(ascii_lower(text), SEPARATORS)


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, mark, pos and term of every word of every document."""
    parts, _ = word_pieces(F.col("text"))
    return docs.select("doc_id", text_mark(F.col("text")).alias("mark"), F.posexplode(parts).alias("pos", "term")).where("term != ''")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, win (its words joined by blanks) and n (how many), once for each item and window."""
    parts, _ = word_pieces(F.col("text"))
    words = items.where("item_id is not null").select("item_id", F.filter(parts, lambda w: w != "").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    cut = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("cut"))
    return cut.select("item_id", F.array_join("cut", " ").alias("win"), F.size("cut").alias("n")).distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term and how often it occurs, for those of ``terms`` (column term) that occur at all."""
    return tokens(docs).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("occurs"))


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings (term, doc_id, mark, pos), as runs sorted by term; of all terms, or of those in ``terms``."""
    found = tokens(docs) if terms is None else tokens(docs).join(terms, "term", "left_semi")
    return materialize(found.select(*RUN).sortWithinPartitions(*RUN), "postings")


def lookup_plan(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """For each window that can occur: win_id, win, n, and term and offset of its rarest and second rarest slot.

    A window holds ``WINDOW`` slots at most, so its list is short. A window of one word has no second slot.
    """
    slots = wins.select("win", "n").distinct().select("win", "n", F.posexplode(F.split("win", " ")).alias("offset", "term"))
    ranked = slots.join(counts, "term").groupBy("win", "n").agg(F.sort_array(F.collect_list(F.struct("occurs", "term", "offset"))).alias("slots"))
    pick = lambda i, field: F.get("slots", F.lit(i))[field]
    return ranked.where(F.size("slots") == F.col("n")).select(
        F.xxhash64("win").alias("win_id"), "win", "n", pick(0, "term").alias("term"), pick(0, "offset").alias("first_offset"),
        pick(1, "term").alias("second_term"), pick(1, "offset").alias("second_offset"),
    )


def alignments(index: DataFrame, plan: DataFrame) -> DataFrame:
    """win_id, n, doc_id, mark and start where the two rarest terms of a window stand at their offsets."""
    lists = index.join(plan.drop("win"), "term").withColumn("start", F.col("pos") - F.col("first_offset")).where("start >= 0")
    other = index.select(F.col("term").alias("t"), F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("pos").alias("p"))
    both = lists.where("second_term is not null").join(
        other, (F.col("second_term") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")) & F.col("mark").eqNullSafe(F.col("m"))
        & (F.col("start") + F.col("second_offset") == F.col("p")), "left_semi")
    columns = ["win_id", "n", "doc_id", "mark", "start"]
    return both.select(*columns).unionByName(lists.where("second_term is null").select(*columns))


def phrase_matches(docs: DataFrame, index: DataFrame, plan: DataFrame) -> DataFrame:
    """doc_id, mark, start, n and win of every occurrence of a window, once each."""
    # Alignments are gathered for each document, as many as it has positions, before they meet its text.
    found = alignments(index, plan).groupBy(F.col("doc_id").alias("found_id"), F.col("mark").alias("found_mark")).agg(
        F.collect_set(F.struct("win_id", "start", "n")).alias("places"))
    found = materialize(found, "alignments")
    # Their narrow keys alone cut the corpus down first: where these are small enough to be broadcast, only texts with an
    # alignment are moved, and otherwise both joins use one exchange.
    keys = materialize(found.select(F.col("found_id").alias("key_id"), F.col("found_mark").alias("key_mark")), "aligned")
    parts, _ = word_pieces(F.col("text"))
    docs = docs.select("doc_id", "text")
    docs = docs.join(keys, same_row(docs, "key_id", "key_mark"), "left_semi")
    spread = docs.join(found, same_row(docs, "found_id", "found_mark")).select(
        "doc_id", F.col("found_mark").alias("mark"), parts.alias("parts"), F.explode("places").alias("at")
    ).select("doc_id", "mark", "at.*", F.array_join(F.slice("parts", F.col("at.start") + 1, F.col("at.n")), " ").alias("win"))
    matches = spread.join(plan.select("win_id", "win"), ["win_id", "win"], "left_semi").select("doc_id", "mark", "start", "n", "win").distinct()
    return materialize(matches, "matches")


def proximity_matches(index: DataFrame, plan: DataFrame, slack: int = WINDOW) -> DataFrame:
    """doc_id, mark, win and start where the second rarest term of a window stands within ``slack`` words of its offset.

    Positions are put into cells of ``slack`` words, so each posting meets those of three cells and not a whole list. The
    index must hold the terms of ``plan``.
    """
    cell = lambda c: F.floor(c / slack)
    lists = index.join(plan.where("second_term is not null"), "term").withColumn("start", F.col("pos") - F.col("first_offset"))
    lists = lists.withColumn("due", F.col("start") + F.col("second_offset")).withColumn("cell", F.explode(F.sequence(cell(F.col("due")) - 1, cell(F.col("due")) + 1)))
    other = index.select(F.col("term").alias("t"), F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("pos").alias("p"), cell(F.col("pos")).alias("c"))
    near = lists.join(other, (F.col("second_term") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")) & F.col("mark").eqNullSafe(F.col("m"))
                      & (F.col("cell") == F.col("c")) & (F.abs(F.col("p") - F.col("due")) <= slack))
    return near.select("doc_id", "mark", "win", "start").distinct()


def find_windows(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items' windows and where they occur in ``docs``: count terms, choose the rarest, index them, intersect."""
    wins = materialize(windows(items), "windows")
    terms = materialize(wins.select(F.explode(F.split("win", " ")).alias("term")).distinct(), "terms")
    plan = materialize(lookup_plan(wins, materialize(term_counts(docs, terms), "counts")), "lookups")
    asked = plan.select("term").union(plan.where("second_term is not null").select("second_term")).distinct()
    index = build_index(docs, materialize(asked, "asked"))
    return wins, phrase_matches(docs, index, plan)


def hits(wins: DataFrame, matches: DataFrame) -> DataFrame:
    """Per document with a match: n_hit, n_items and items_sha256."""
    places = matches.select("doc_id", "mark", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    before = Window.partitionBy("doc_id", "mark").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = places.withColumn("from", F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.col("start"))))
    n_hit = covered.groupBy("doc_id", "mark").agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).cast("long").alias("n_hit"))
    items = matches.select("doc_id", "mark", "win").distinct().join(wins.select("item_id", "win"), "win").select("doc_id", "mark", F.col("item_id").cast("string").alias("item")).distinct()
    named = items.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(
        F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    return n_hit.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("mark").eqNullSafe(F.col("m"))).select(
        F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"), "n_hit", "n_items", "items_sha256")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    found = materialize(hits(*find_windows(docs, items)), "hits")
    _, n_words = word_pieces(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), n_words.alias("n_words"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & F.col("mark").eqNullSafe(F.col("hit_mark")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        "doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs; columns as given."""
    _, matches = find_windows(docs.select("doc_id", "text"), items)
    hit_id, hit_mark = fresh(docs, "hit_id", "hit_mark")
    hit = materialize(matches.select(F.col("doc_id").alias(hit_id), F.col("mark").alias(hit_mark)).distinct(), "contaminated")
    return docs.join(hit, same_row(docs, hit_id, hit_mark), "left_anti")
