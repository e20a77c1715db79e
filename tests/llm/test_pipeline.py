"""The pipeline's rows against the same decisions taken one after the other on the driver."""

import corpus_pipeline
from pyspark.sql import functions as F

from unitloom.llm import decontamination, mixing, simhash_dedup, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_are_the_ones_dealt():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_agrees_with_the_operators_decisions(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    docs, labels, bench = read("documents"), read("labels"), read("benchmark")
    ids = {r.doc_id for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.scored(docs, toxicity.learn(docs, labels)).collect() if r.predicted}
    left = ids - toxic
    some = lambda keep: docs.where(F.col("doc_id").isin(sorted(keep)))
    left = {r.component_id for r in simhash_dedup.near_duplicates(some(left)).collect()}
    left -= {r.doc_id for r in decontamination.contamination(some(left), bench).collect() if r.contaminated}
    left = {r.doc_id for r in mixing.mixed(some(left)).collect() if r.kept}
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in found} == left and len(found) == len(left)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == texts[r.doc_id] for r in found)
    counts = [sum(r.shard == s for r in found) for s in range(40)]
    assert max(counts) - min(counts) <= 1


def test_each_stage_keeps_the_columns_and_stands_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs.limit(0), SF)
        assert found.count() == 0
        assert name == "sharding" or found.columns == docs.columns


def test_each_stage_stands_odd_rows(spark, documents, edges):
    docs = documents(edges, clash=True)
    kept = {"toxicity": 8, "simhash_dedup": 5, "decontamination": 8, "mixing": None, "sharding": 8}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF).collect()
        assert kept[name] is None or len(found) == kept[name], name
        assert {r.doc_id for r in found} <= {i for i, _ in edges}
        assert all((r.doc_id, r.text) in edges for r in found)
