from collections import Counter

import corpus_pipeline
from roadlens.llm import mixing, quality


def test_stages_and_run(spark, small):
    """Each stage against what it says of its own input."""
    from test_dedup import brute_near, words_of

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    good, once, distinct, mixed = [None] * 4
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, small).cache()
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
    once = stages["exact_dedup"](spark, good, small).cache()
    norms = ["".join(words_of(r["text"])) for r in once.collect()]
    assert sorted(norms) == sorted({"".join(words_of(r["text"])) for r in good.collect()})
    distinct = stages["near_dedup"](spark, once, small).cache()
    want = {key[0] for key in brute_near(once.collect(), 80, 5) if key[3]}
    assert {r["doc_id"] for r in distinct.collect()} == want
    mixed = stages["source_mixing"](spark, distinct, small).cache()
    taken = Counter()
    for r in mixed.collect():
        taken[r["doc_id"]] += len(words_of(r["text"]))
    assert taken == Counter({r["doc_id"]: r["taken"] for r in mixing.mix(distinct).where("taken > 0").collect()})
    for df in (good, once, distinct, mixed):
        assert df.columns == docs.columns
    rows = corpus_pipeline.run(spark, small).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows) == Counter(
        (r["doc_id"], r["piece"], r["ids_crc32"]) for r in stages["best_fit_packing"](spark, mixed, small).collect()
    )


def test_awkward(spark, awkward, empty):
    """Nulls, ties, repeated rows, long texts and columns with the stages' own names pass through all stages."""
    for docs in (awkward, empty):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            docs.count()
            assert name == "best_fit_packing" or docs.columns == names
