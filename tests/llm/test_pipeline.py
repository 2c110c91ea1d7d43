"""The pipeline on the smallest tables, stage by stage against plain code."""

import corpus_pipeline
from lodestone.llm.common import Scratch
from tests.llm.test_operators import brute_components, brute_lines, brute_overlaps


def test_stages(spark, sf_dir):
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.save(stage(spark, docs, sf_dir), name)
        rows = out.collect()
        if name != "sentencepiece":
            assert out.columns == docs.columns
            after = {r["doc_id"]: r["text"] for r in rows}
            assert len(after) == len(rows)
        if name == "language_id":
            # what goes has no letter, or no language that stands out; prose in a known language stays
            known = {r["doc_id"] for r in docs.collect() if r["lang"] and r["text"] and len(r["text"].split()) >= 20}
            assert all(any(c.isalpha() for c in t) for t in after.values())
            assert len(known - set(after)) <= 0.02 * len(known) and len(known) > 100
        elif name == "line_dedup":
            want = {d: t for d, t in brute_lines(before).items() if t == before[d] or t.split()}
            assert after == want and after != before
        elif name == "near_dedup":
            assert set(after) == {d for d, (_, _, kept) in brute_components(before).items() if kept}
        elif name == "decontamination":
            assert set(after) == {d for d, hits in brute_overlaps(before, items).items() if not hits}
        else:
            assert {r["doc_id"] for r in rows} == set(before) and all(r["round_trip"] for r in rows)
        docs, before = out, after


def test_line_dedup_leaves_are_not_broadcast(spark, sf_dir, monkeypatch):
    """The leaves that may recur, by salt, grow with the corpus and must not meet in the driver,
    whatever the size of their file."""
    plans, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or save(self, df, name))
    corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert "SortMergeJoin" in plans["weight"] and "Broadcast" not in plans["weight"]
