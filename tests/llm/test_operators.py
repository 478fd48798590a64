import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import oracle
import pytest
from conftest import COPY, FOLDER, LONG, ODD_ROWS
from pyspark.sql import functions as F

from trackloom.llm import components, decontamination, language, mixing, quality, queries, repeated_spans, secret_scan, sharding, simhash, url_cascade, vector_tree
from trackloom.llm.common import table

TEXTS = [(r[0], r[1]) for r in ODD_ROWS]


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def norm(found):
    return sorted(found, key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    same, message = oracle.compare(queries.QUERIES[name](spark, FOLDER), oracle.connect(FOLDER), queries.SQL[name])
    assert same, message


# 1 -----------------------------------------------------------------------------------------------------------------

ITEMS = [
    (1, "one of the many copied texts that stand here twice and are long enough"), (2, "tie"), (3, None), (4, ""), (5, "!!"), (None, "plain words"),
    (6, " ".join(LONG.split()[500:530])), (7, "x x x x x x x x x x x"), (8, "tie"), (8, "plain words"), (9, "the the the"), (10, "words that occur nowhere at all"),
]
COLUMNS_1 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_contamination_odd(spark, odd):
    more = [(20, "the the the the"), (21, "x " * 40), (22, "TIE; Tie. the THE the")]
    docs = odd.select("doc_id", "text", "mark", "term").union(spark.createDataFrame([(*m, "x", "x") for m in more], "doc_id long, text string, mark string, term string"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = rows(decontamination.contamination(docs, items), *COLUMNS_1)
    assert norm(found) == norm(brute.contamination(TEXTS + more, ITEMS))
    left = decontamination.drop_contaminated(odd, items)
    assert left.columns == odd.columns
    clean = [d for d, *_, hit in brute.contamination(TEXTS, ITEMS) if not hit]
    assert norm([d for d, in rows(left, "doc_id")]) == norm(clean)


def test_contamination_empty(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert not decontamination.contamination(none, items).collect()
    assert all(not r["contaminated"] for r in decontamination.contamination(odd, items.where("false")).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha one two beta gamma three delta"), (3, "delta " + "z " * 50 + "alpha")], "doc_id long, text string")
    wins = decontamination.windows(spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string"))
    terms = wins.select(F.explode(F.split("win", " ")).alias("term"))
    plan = decontamination.lookup_plan(wins, decontamination.term_counts(docs, terms))
    near = decontamination.proximity_matches(decontamination.build_index(docs), plan, 4)
    assert {r["doc_id"] for r in near.collect()} == {1, 2}


# 2 -----------------------------------------------------------------------------------------------------------------

URLS = [
    (1, "https://A.Example.ORG/es/1"), (2, "http://example.org/en/17?x=://y"), (3, "http://example.com/fr/"), (4, "http://x.com/de/q#f"), (5, "http://x.com/en"),
    (6, None), (7, ""), (8, "no scheme"), (9, "://"), (10, "http://org"), (11, "http://spam.net/a"), (12, "http://x.spam.net?q"), (13, "http://notorg/"), (14, "http://.org/"),
    (15, "http://example.org/en/2"), (None, "http://example.org/es/"), (1, "http://b.org/es/1"), (16, "http://a.com/FR/"), (17, "http://www.x-casino.net/" + "p" * 9000), (18, "http://a\nb.org/x\ny"),
]


def judged(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(brute.LOWER), m[2]) if m else ("", "")
    fit = max(((len(h + p), h + p, v) for h, p, v in url_cascade.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, fit


def test_url_cascade_odd(spark, monkeypatch):
    pages = spark.createDataFrame([(*u, "x", "x") for u in URLS], "page_id long, url string, host string, rule string")
    wanted = []
    for page, url in URLS:
        host, path, fit = judged(url)
        labels = [set(re.split(r"[.-]", h)) for h in {judged(u)[0] for _, u in URLS}]
        listed = any({"spam", "casino"} & set(re.split(r"[.-]", h)) and (host == h or host.endswith("." + h)) for h in {judged(u)[0] for _, u in URLS})
        assert labels
        wanted.append((page, host, path, fit[1] if fit else None, fit[2] if fit else "block" if listed else "allow"))
    columns = ("page_id", "host", "path", "rule", "verdict")
    assert norm(rows(url_cascade.judge(pages), *columns)) == norm(wanted)
    monkeypatch.setattr(url_cascade, "MOST_BITS", 0)  # lists beyond the bound are joined
    assert norm(rows(url_cascade.judge(pages), *columns)) == norm(wanted)
    assert not url_cascade.judge(pages.where("false")).collect()


def test_cascade_is_exact(spark):
    numbers = spark.range(30_000)
    h1, h2 = url_cascade.hashes(F.col("id").cast("string"))
    keys = numbers.select("id", h1.alias("h1"), h2.alias("h2"))
    levels = url_cascade.build_cascade(keys.where("id % 37 = 0"), keys.where("id % 37 != 0"))
    at = keys.toPandas()
    assert len(levels) > 1
    assert (url_cascade.member(levels, at["h1"].to_numpy(), at["h2"].to_numpy()) == (at["id"] % 37 == 0)).all()


# 3 -----------------------------------------------------------------------------------------------------------------

COLUMNS_3 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def check_spans(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert norm(rows(repeated_spans.deduplicate(df), *COLUMNS_3)) == norm(brute.repeated_spans(docs))


def test_repeated_spans_table(spark, docs):
    check_spans(spark, docs)


@pytest.mark.parametrize("seed", range(3))
def test_repeated_spans_random(spark, seed, monkeypatch):
    """Texts glued from shared passages; small pieces, so that long texts are cut; buckets that count as crowded."""
    monkeypatch.setattr(repeated_spans, "PIECE", 700)
    monkeypatch.setattr(repeated_spans, "CROWDED", [10, 50_000, 1][seed])
    monkeypatch.setattr(repeated_spans, "CROWDED_IN_PIECE", 2)
    rng = random.Random(seed)
    letters = ["abcdefgh é", "ab", "a"][seed]
    passages = ["".join(rng.choice(letters) for _ in range(rng.choice([30, 60, 99, 100, 101, 150, 400]))) for _ in range(12)]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(rng.randrange(12))) for _ in range(60)]
    check_spans(spark, list(enumerate(texts)))


def test_repeated_spans_odd(odd, none):
    found = {(r["doc_id"], r["n_bytes"]): r for r in repeated_spans.deduplicate(odd, with_text=True).collect()}
    assert found[5, len(COPY)]["n_removed"] == len(COPY) and found[5, len(COPY)]["kept"] == b"" and found[4, len(COPY)]["n_removed"] == 0
    assert found[2, 0]["kept_sha256"] == found[None, 0]["kept_sha256"] == brute.sha("")
    assert found[11, 5000]["n_removed"] == 4999  # every byte but the first lies in a repeat
    own, = brute.repeated_spans([(6, LONG)])  # equal rows are one document
    assert tuple(found[6, len(LONG)][c] for c in COLUMNS_3) == own
    assert not repeated_spans.deduplicate(none).collect()


def test_repeated_ids_have_numbers_of_their_own(spark):
    """Many texts under one id and under none; in 26 bits of a hash some of them would be one document."""
    texts = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, 5).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    some = spark.createDataFrame([(1, "alone"), (2, "twice"), (2, "twice"), (3, None), (3, "")], "doc_id long, text string")
    found = repeated_spans.keyed(texts.union(texts.limit(10)).union(some)).select("doc", "mark", "doc_id", "text").distinct().collect()
    assert len(found) == 60_004 and len({(r["doc"], r["mark"]) for r in found}) == 60_004
    assert max(r["mark"] for r in found) == 29_999 and {r["mark"] for r in found if r["doc_id"] in (1, 2)} == {0}


# 4 -----------------------------------------------------------------------------------------------------------------

def test_quality(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    found = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = found[found["held_out"]]
    assert len(found) > 300 and (held["predicted"] == held["quality"]).mean() > 0.9
    assert found["score"].between(0, 1).all()
    again = quality.classify(docs, labels).join(labels, "doc_id").toPandas().set_index("doc_id")["score"]
    assert np.allclose(found.set_index("doc_id")["score"].sort_index(), again.sort_index(), atol=1e-9)


def test_quality_density():
    """Scores against densities by a solver that knows nothing of Cholesky factors."""
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    x = {k: rng.normal(k, 1 + k, (400, d)) @ rng.normal(0, 1, (d, d)) for k in (0, 1)}
    model = quality.fit({k: (len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()}, pool=0.0, diagonal=0.0)
    z = {k: (v - model.centre) / model.scale for k, v in x.items()}
    logs = []
    for k in (0, 1):
        cov = np.cov(z[k].T, bias=True)
        gap = z[0] - z[k].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.score(x[0]), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))), atol=1e-6)


def test_quality_counts():
    texts = ["Ab 12 ab\nab ab|", "", "é", LONG]
    data = "".join(texts).encode()
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    c = quality.counts(np.frombuffer(data, np.uint8), bounds)
    assert c["words"].tolist() == [5, 0, 1, 60_000] and c["different"].tolist()[:3] == [4, 0, 1]
    assert c["different"][3] == len(set(LONG.split())) and c["top"][3] == max(Counter(LONG.split()).values())
    assert c["upper"].tolist() == [1, 0, 0, 0] and c["lines"].tolist() == [2, 0, 1, 1] and c["digit"][0] == 2
    whole = quality.statistics(np.frombuffer(data, np.uint8), bounds)
    parts = quality.statistics(np.frombuffer(data, np.uint8), bounds, 1000)
    assert np.allclose(whole[:3], parts[:3]) and np.isfinite(parts).all()


@pytest.mark.parametrize("limit", [1, 7, 1000, 40_000])
def test_quality_does_not_depend_on_pieces(limit):
    """A text's statistics are the same whatever piece it is read in: cut words and lines, repeated ones, none at all."""
    some = " ".join(f"w{i}" for i in range(300))
    texts = [LONG[:50_000], "\n".join([some] * 6), "x" * 300, "a a a b\n\n a a\na", "\n \n", "ab" * 40 + "\n" + "ab" * 40, "é ü é ü\n" * 30, " lead and trail \n"]
    for text in texts[1 if limit < 1000 else 0 :]:
        data = np.frombuffer(text.encode(), np.uint8)
        bounds = np.array([0, len(data)])
        whole = quality.transform(quality.counts(data, bounds))
        assert np.allclose(quality.statistics(data, bounds, limit), whole, rtol=0, atol=1e-12), text[:20]


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (8, 0), (4, 1), (11, 0), (5, 1), (7, None), (None, 1), (3, 0)], "doc_id long, quality int")
    for some in (labels, labels.where("false"), labels.where("quality = 1")):
        found = quality.classify(odd, some).collect()
        assert len(found) == len(ODD_ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    assert not quality.classify(none, labels).collect()
    assert quality.keep_good(odd, odd, labels).columns == odd.columns


# 5 -----------------------------------------------------------------------------------------------------------------

def brute_neighbours(vectors, k=20, step=20):
    ids, x = np.array([v[0] for v in vectors]), np.array([v[1] for v in vectors], np.float64)
    out = set()
    for i in np.flatnonzero(ids % step == 0):
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out |= {(int(ids[i]), n + 1, int(ids[j]), float(score[j])) for n, j in enumerate(order)}
    return out


def test_neighbours_recall(spark):
    e = table(spark, "/root/testdata/sf0.01", "embeddings")
    exact = brute_neighbours([tuple(r) for r in e.select("vec_id", "embedding").collect()])
    found = set(rows(vector_tree.search(e), "query_id", "rank", "vec_id", "score"))
    assert len(found) == len(exact)
    hit = {(q, v) for q, _, v, _ in found} & {(q, v) for q, _, v, _ in exact}
    assert len(hit) >= 0.9 * len(exact)
    full = vector_tree.exact_neighbours(e)
    assert {r[:3] for r in rows(full, "query_id", "rank", "vec_id", "score")} == {r[:3] for r in exact}
    assert vector_tree.recall(vector_tree.search(e), full) >= 0.9


def test_neighbours_odd(spark, monkeypatch):
    monkeypatch.setattr(vector_tree, "TILE", 16)
    good = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(100)] + [(i, [2.0, 2.0, 2.0]) for i in range(100, 160)]
    bad = [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 1.0]), (260, [1.0, float("nan"), 1.0]), (280, [float("inf"), 1.0, 1.0]), (300, [1.0]), (None, [1.0, 1.0, 1.0])]
    repeated = [(20, [9.0, 9.0, 9.0]), (100, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame(good + bad + repeated, "vec_id long, embedding array<float>")
    found = rows(vector_tree.search(df, target=1.0), "query_id", "rank", "vec_id", "score")
    assert set(found) == brute_neighbours(good + repeated) and len(found) == 20 * 10  # eight ids asking, two of them twice
    assert (0, 1, 20, 9.0) in found and (20, 1, 20, 81.0) in found  # the other row of an id is a neighbour like any other
    few = spark.createDataFrame(good[:5] + [(20, [1.0, 1.0, 1.0])], "vec_id long, embedding array<float>")
    assert set(rows(vector_tree.search(few), "query_id", "rank", "vec_id", "score")) == brute_neighbours(good[:5] + [(20, [1.0, 1.0, 1.0])])
    assert not vector_tree.search(df.where("vec_id = 200")).collect() and not vector_tree.search(df.where("false")).collect()
    assert not vector_tree.search(df.where("vec_id = 40")).collect()


# 6 -----------------------------------------------------------------------------------------------------------------

SECRETS = [
    (30, "password: hunter22 and PASSWD='abc' token==abcdefg api_key = \"Zz9/+=-_.\" apikey:short5 secret:  123456"), (31, "AKIA" + "B" * 16 + "c AKIAAKIA" + "1" * 12 + " AKIA12"),
    (32, "deadbeef" * 3 + " " + "a" * 23 + " x" + "0123456789abcdef" * 10), (33, "ſecret=abcdefgh toKen=abcdefgh"), (34, "😀 token=abcdef 😀 token=abcdef"), (35, "passwordpassword=abcdefg secret:token:abcdefg"),
    (36, "AKIA"), (37, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 18 + " xoxb-1234567890a eyJabcdefgh.abcdefgh.abcdefgh"),
]


def check_secrets(spark, docs, df=None):
    df = spark.createDataFrame(docs, "doc_id long, text string") if df is None else df
    found = rows(secret_scan.scan(df), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert norm(found) == norm([(d, *brute.secrets(t)[:3], brute.sha(brute.secrets(t)[3])) for d, t in docs])


def test_secrets(spark, docs, odd, none):
    check_secrets(spark, docs + SECRETS)
    check_secrets(spark, TEXTS, odd)
    assert not secret_scan.scan(none).collect()
    spans = dict(rows(secret_scan.scan(spark.createDataFrame(SECRETS, "doc_id long, text string")), "doc_id", "spans"))
    assert {s.split(":")[0] for s in spans[37].split(",")} == {"private", "github", "hex", "slack", "jwt"} - ({"hex"} if "hex" not in spans[37] else set())
    assert spans[34] == brute.secrets(dict(SECRETS)[34])[3]


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]{24,}") is True
    assert secret_scan.trigram_query("abc.*def") == ("and", frozenset({b"abc", b"def"}))
    assert secret_scan.trigram_query("(abc|xyz)+") == ("or", frozenset({b"abc", b"xyz"}))
    assert secret_scan.trigram_query("ab?cd") == ("or", frozenset({("and", frozenset({b"abc", b"bcd"})), b"acd"}))
    assert secret_scan.trigram_query("(abc)?def") == b"def" or b"def" in secret_scan.trigrams_of(secret_scan.trigram_query("(abc)?def"))
    with pytest.raises(ValueError):
        secret_scan.trigram_query("(?i)token")


@pytest.mark.parametrize("pattern", [r"ab?cd+e", r"(foo|ba[rz])[0-9]+qux", r"x(yz)*abc", r"(a|b|c)(d|e)f[0-9]?gh", r"a.c(def|ghi){2}", r"\bword\d*end", r"(?:abc|d)ef"])
def test_trigram_query_misses_nothing(pattern):
    """Whatever matches must satisfy the query."""
    rng, low = random.Random(pattern), b""
    pool = ["ab", "a", "b", "c", "cd", "d", "e", "foo", "bar", "baz", "qux", "x", "yz", "abc", "f", "gh", "def", "ghi", "word", "end", "1", "a1c", " ", "ef"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(9))) for _ in range(6000)]
    query = secret_scan.trigram_query(pattern)
    holds = lambda q, t: True if q is True else q in t if isinstance(q, bytes) else (all if q[0] == "and" else any)(holds(p, t) for p in q[1])
    assert low == b"" and all(holds(query, t.encode()) for t in texts if re.search(pattern, t))


# 7 -----------------------------------------------------------------------------------------------------------------

def test_language(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = language.identify(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found["held_out"]]
    assert len(held) > 100 and (held["lang"] == held["lang_pred"]).mean() > 0.95 and found["score"].between(0, 1).all()


def test_language_plain(spark, odd):
    """Profiles and distances against a version with dictionaries."""
    def grams(text):
        out = Counter()
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            w = f" {w} "
            out.update(g for n in (1, 2, 3) for i in range(len(w) - n + 1) if (g := w[i : i + n]) != " ")
        return out

    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], sum(ord(ch) << 21 * (len(x[0]) - 1 - i) for i, ch in enumerate(x[0]))))][:language.PROFILE]
    learn = odd.where(~language.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").collect()
    sums = defaultdict(Counter)
    for r in learn:
        sums[r["lang"]].update(grams(r["text"]))
    profiles = {k: {g: i for i, g in enumerate(order(c))} for k, c in sums.items() if c}
    judge = language.learn(odd)
    assert judge.langs == sorted(profiles)
    for _, text, *_ in ODD_ROWS:
        own = order(grams(text))
        distance = {k: sum(abs(i - p[g]) if g in p else language.PROFILE for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(distance), key=distance.get) if own else "und"
        assert judge(text)[0] == best, text
    assert judge("漢字")[0] != "und" and judge("123 !?") == ("und", 0.0) and judge(None) == ("und", 0.0)


def test_language_pieces(monkeypatch):
    whole = language.ngrams(LONG + " été")
    monkeypatch.setattr(language, "PIECE", 100)
    assert all((a == b).all() for a, b in zip(whole, language.ngrams(LONG + " été")))


def test_language_odd(spark, odd, none):
    found = language.identify(odd, language.learn(odd)).collect()
    assert len(found) == len(ODD_ROWS) and all(r["lang_pred"] == "und" for r in found if r["doc_id"] in (2, 3, 8, 9))
    assert not language.identify(none, language.learn(none)).collect()
    assert {r["lang_pred"] for r in language.identify(odd, language.learn(none)).collect()} == {"und"}


# 8 -----------------------------------------------------------------------------------------------------------------

COLUMNS_8 = ("doc_id", "fingerprint", "component_id")


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_close_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 20, np.uint64)
    prints = np.unique(np.concatenate([base[rng.integers(0, 20, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)), base]))
    i, j = simhash.close_pairs(prints, radius)
    wanted = {(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if int(prints[a] ^ prints[b]).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist())) == wanted


def test_groups_lose_no_pair(spark):
    """A dense cluster is split into small groups that still hold every close pair."""
    rng = np.random.default_rng(5)
    flips = [0, *(1 << int(b) for b in range(64)), *((1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2)))]
    prints = sorted({0x123456789ABCDEF0 ^ f for f in flips})
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    members = defaultdict(set)
    for mask, value, fp in rows(simhash.grouped(df, most=64), "mask", "value", "fp"):
        members[mask, value].add(fp & simhash.ALL_BITS)
    assert max(map(len, members.values())) <= 64
    together = {(a, b) for group in members.values() for a in group for b in group}
    assert all((a, b) in together for a in prints for b in prints if (a ^ b).bit_count() <= 2)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(200, 201), (201, 200), (202, 201), (5, 5)]
    found = dict(rows(components.components(spark.createDataFrame(edges, "x long, y long")), "node", "root"))
    assert found == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 140)} | {201: 200, 202: 200}
    assert not components.components(spark.createDataFrame([], "x long, y long")).collect()


def test_near_duplicates(spark, docs, odd, none):
    near = [(1000 + i, t + (" end" if i % 2 else "")) for i, (_, t) in enumerate(docs[:40])]
    df = spark.createDataFrame(docs + near, "doc_id long, text string")
    assert norm(rows(simhash.near_duplicates(df), *COLUMNS_8)) == norm(brute.components(docs + near))
    assert norm(rows(simhash.near_duplicates(odd), *COLUMNS_8)) == norm(brute.components(TEXTS))
    assert not simhash.near_duplicates(none).collect()


def test_keep_one(odd):
    left = simhash.keep_one(odd)
    assert left.columns == odd.columns
    # Of the texts without words doc 2 stays, of the copies doc 4, of the repeated row one.
    assert norm([d for d, in rows(left, "doc_id")]) == norm([1, 2, 4, 6, 7, 7, None, 8, 10, 11])


# 9 -----------------------------------------------------------------------------------------------------------------

def test_lookup_table():
    names = sharding.shard_names(7)
    owner = sharding.fill_table(names, 1009)
    counts = np.bincount(owner)
    assert len(counts) == 7 and counts.max() - counts.min() <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = (owner != fewer) & (owner != 6)
    assert moved.mean() < 0.15  # most keys of the shards that stay, stay
    for wrong in ((names, 1000), ([], 7), (["a", "a"], 7), (names, 5)):
        with pytest.raises(ValueError):
            sharding.fill_table(*wrong)


def test_placement(spark, odd, none, tmp_path):
    placed = sharding.place(odd)
    owner = sharding.fill_table(sharding.shard_names())
    found = rows(placed, "doc_id", "slot", "shard")
    assert len(found) == len(ODD_ROWS) and all(owner[slot] == shard for _, slot, shard in found)
    assert len({(d, s) for d, s, _ in found}) == len({d for d, *_ in found})
    assert placed.columns == [c for c in odd.columns if c not in ("shard", "Slot")] + ["shard", "slot"]
    slots = dict(rows(odd.select("doc_id", F.expr(f"pmod(xxhash64(doc_id), {sharding.TABLE_SIZE})").alias("s")), "doc_id", "s"))
    assert all(slots[d] == s for d, s, _ in found)
    assert not sharding.place(none).collect()
    sharding.write_shards(odd.drop("Slot"), str(tmp_path / "out"), names=["a", "b"], size=11)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ODD_ROWS) and {r["shard"] for r in back.select("shard").distinct().collect()} <= {0, 1}


# 10 ----------------------------------------------------------------------------------------------------------------

def check_mix(found):
    sizes, most, taken, target = Counter(), Counter(), Counter(), {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
        sizes[r["source"]] += r["size"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    wanted = brute.targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(wanted[s], abs=1e-6)
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6
        copies = {r["copies"] for r in found if r["source"] == s and r["size"]}
        assert max(copies, default=0) - min(copies, default=0) <= 1  # complete epochs first


def test_mixing(spark, odd, none):
    for docs in (table(spark, FOLDER, "documents"), odd):
        found = mixing.mix(docs).collect()
        assert len(found) == docs.count()
        check_mix(found)
        again = mixing.mix(docs.repartition(7)).collect()
        assert norm((r["doc_id"], r["taken"]) for r in found) == norm((r["doc_id"], r["taken"]) for r in again)
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix(odd).collect()}
    assert sizes[2] == sizes[3] == sizes[9] == 0 and sizes[6] == 60_000
    assert not mixing.mix(none).collect()


def plain_mix(measured):
    """Words taken of every row: each source in key order until its target is used up."""
    sizes, out = Counter(), []
    for m in measured:
        sizes[m["source"]] += m["size"]
    for source, target in brute.targets(dict(sizes)).items():
        epochs, ahead = int(target // sizes[source]) if sizes[source] else 0, 0
        for m in sorted((m for m in measured if m["source"] == source), key=lambda m: (m["key"], m["doc_id"], m["mark"])):
            extra = ahead + m["size"] / 2 <= target - epochs * sizes[source]
            out.append((m["doc_id"], m["mark"], source, m["size"] * (epochs + extra)))
            ahead += m["size"]
    return out


@pytest.mark.parametrize("hot", [3, 7, 11, 12])
def test_mix_of_one_repeated_row(spark, monkeypatch, hot):
    """Most rows of a source are one row, at whatever place of the order: exactly the documents of the plain version."""
    monkeypatch.setattr(mixing, "RUN", 7)
    texts = [(i, " ".join(["w"] * (1 + i % 9)), "en", "abc"[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(texts + [texts[hot]] * 400, "doc_id long, text string, lang string, source string")
    found = rows(mixing.mix(docs), "doc_id", "mark", "source", "taken")
    assert norm(found) == norm(plain_mix(mixing.measured(docs).collect()))


@pytest.mark.parametrize("sizes", [{"a": 5, "b": 5, "c": 5}, {"a": 1, "b": 1, "c": 1000, None: 50, "e": 0}, {"a": 0}, {"a": 9}, {"z": 1, "y": 2, "x": 3, "w": 400}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    assert dict(rows(mixing.targets(df), "source", "target")) == pytest.approx(brute.targets(sizes))


def test_mix_prefers_quality(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "good words here").otherwise("b#d $$$ @@@").alias("text"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"))
    taken = {r["g"]: r["n"] for r in mixing.mix(docs).where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("g")).agg(F.sum("copies").alias("n")).collect()}
    assert taken[0] > 1.3 * taken[1]


def test_apply_mix(odd):
    out = mixing.apply_mix(odd)
    assert out.columns == odd.columns
    wanted = Counter()
    for r in mixing.mix(odd).collect():
        wanted[r["doc_id"]] += r["copies"]
    assert Counter(d for d, in rows(out, "doc_id")) == +wanted
