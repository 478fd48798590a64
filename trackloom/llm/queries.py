"""Each training-data operator applied to its whole table, and equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.llm import decontamination, language, merge_encoding, mixing, prefix_trie, quality, repeated_spans, secret_scan, sharding, simhash, spelling, url_cascade, vector_tree
from trackloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op4_quality_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register
def op9_lookup_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(table(spark, folder, "documents").select("doc_id", "source"))


@register
def op10_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "copies")


@register
def op7_rank_order_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.learn(docs))


@register
def op6_trigram_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))


@register
def op2_url_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return url_cascade.judge(table(spark, folder, "pages"))


SQL["op2_url_cascade"] = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id),
listed AS (
  SELECT DISTINCT host AS listed_host FROM parts
  WHERE regexp_matches(host, '(^|[.-])(spam|casino|adult|malware|phishing)([.-]|$)')),
on_list AS (SELECT DISTINCT page_id FROM parts JOIN listed ON host = listed_host OR ends_with(host, '.' || listed_host))
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.rule_verdict, CASE WHEN o.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f USING (page_id) LEFT JOIN on_list o USING (page_id)
"""


@register
def op1_positional_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL["op1_positional_decontamination"] = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS words
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS words
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, array_to_string(words[i : i + 9], ' ') AS win, least(10, len(words)) AS n
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, greatest(len(words) - n + 2, 1))) AS i FROM lowered, sizes WHERE len(words) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM places JOIN wins USING (win, n)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(l.words), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@register
def op8_bit_sliced_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@register
def op5_tree_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return vector_tree.search(table(spark, folder, "embeddings"))


@register
def op3_suffix_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_spans.deduplicate(table(spark, folder, "documents"))


@register
def op11_merge_encoding(spark: SparkSession, folder: str) -> DataFrame:
    return merge_encoding.digests(table(spark, folder, "documents"), merge_encoding.load(public_tokenizers.path("piece_bpe_32k.model")))


# crc32 of a string, from its bytes; the table's 256 entries by the rule of its polynomial.
_CRC = r"""
crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc32(text: str) -> str:
    code = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {code}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


@register
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


SQL["op12_spelling_variants"] = rf"""
WITH RECURSIVE {_CRC},
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("concat(doc_id, ':', run)")} AS h FROM runs, crc_table),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, i, word[: i - 1] || word[i + 1 :] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
best AS (
  SELECT near.word, count(*) AS n_near, min({{'less': -w.n, 'other': other}}) AS best
  FROM near JOIN words w ON other = w.word GROUP BY near.word),
forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * n THEN best.other END AS form,
    CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS reached FROM forms
  UNION ALL SELECT chain.word, form FROM chain JOIN forms ON reached = forms.word WHERE form IS NOT NULL)
SELECT f.word, reached AS root, f.form, f.n, f.n_near, f.form_n
FROM chain JOIN forms f ON chain.word = f.word JOIN forms tail ON reached = tail.word WHERE tail.form IS NULL
"""


@register
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations"))


SQL["op13_prefix_trie"] = rf"""
WITH {_CRC},
own AS (
  SELECT conv_id, list({{'role': r, 'text': x}} ORDER BY turn NULLS FIRST, r, md5(length(r) || ':' || r || x)) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
asked AS (SELECT conv_id, turns, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM own, crc_table),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(f.turns[1 : h], []), a.turns[h + 1 :]) AS turns
  FROM asked a LEFT JOIN own f ON f.conv_id = a.conv_id - a.conv_id % 20),
ways AS (SELECT conv_id, d, turns[1 : d] AS way, len(turns) = d AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (
  SELECT d, way, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(way[d].text, '[^\x20\x09-\x0D]+')) END AS words
  FROM ways GROUP BY d, way),
kids AS (SELECT d - 1 AS d, way[1 : d - 1] AS way, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.d = k.d AND n.way = k.way),
under AS (
  SELECT up, way[1 : up] AS top, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM full_nodes) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
  n.ends_sha256
FROM full_nodes n JOIN under u ON u.up = n.d AND u.top = n.way LEFT JOIN nodes p ON p.d = n.d - 1 AND p.way = n.way[1 : n.d - 1]
"""
