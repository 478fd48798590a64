from collections import Counter

import brute
import corpus_pipeline
from conftest import FOLDER, ODD_ROWS
from test_near_copies import kept as kept_of

from trackloom.llm import mixing, quality, sharding
from trackloom.llm.common import table


def test_stages(spark):
    """Each stage against a plain version on what its predecessor kept."""
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    pairs = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = pairs(docs)
        docs = corpus_pipeline.materialize(stage(spark, docs, FOLDER), name)
        kept[name] = (before, pairs(docs))
        assert docs.columns == columns + (["shard", "slot"] if name == "place_in_shards" else [])
    before, after = kept["quality_filter"]
    scores = quality.classify(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")).collect()
    assert {d for d, _ in after} == {r["doc_id"] for r in scores if r["predicted"]} and len(after) < len(before)
    before, after = kept["near_copies"]
    assert sorted(d for d, _ in after) == kept_of(sorted(before))
    before, after = kept["benchmark_passages"]
    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    assert {d for d, _ in after} == {d for d, *_, hit in brute.contamination(before, items) if not hit}
    before, after = kept["source_mix"]
    assert 0 < len(after) and max(Counter(d for d, _ in after).values()) <= mixing.MOST and {d for d, _ in after} <= {d for d, _ in before}
    owner = sharding.fill_table(sharding.shard_names())
    assert all(owner[r["slot"]] == r["shard"] for r in docs.select("slot", "shard").collect())
    assert Counter(kept["place_in_shards"][1]) == Counter(kept["place_in_shards"][0])


def test_odd_rows(spark, odd, none):
    for docs, most in ((odd, len(ODD_ROWS)), (none, 0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, FOLDER), name)
            assert docs.count() <= 3 * most


def test_run_repeats(spark):
    first, second = (sorted(map(repr, corpus_pipeline.run(spark, FOLDER).collect())) for _ in range(2))
    assert first == second
