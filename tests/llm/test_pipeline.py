"""The stages against brute force on the same inputs, one after the other."""


import corpus_pipeline
import numpy as np
import test_packing
import test_simhash
from helpers import SF, awkward, clashing, frame

import __spark_entry__ as entry
from seqlabel.llm import quality, toxicity
from seqlabel.llm.queries import QUERIES


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and set(QUERIES) < set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_dedup", "suffix_dedup", "packing"]


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert out.columns == columns
        if name == "quality_rules":
            kept = {r["doc_id"] for r in quality.judged(docs, labels).filter("kept").collect()}
            assert {r["doc_id"] for r in out.collect()} == kept
        elif name == "toxicity":
            kept = {r["doc_id"] for r in toxicity.scored(docs, labels).filter("predicted = 0").collect()}
            assert {r["doc_id"] for r in out.collect()} == kept
        elif name == "near_dedup":
            assert {r["doc_id"] for r in out.collect()} == {c for _, _, c in test_simhash.expected(before)}
        elif name == "suffix_dedup":
            first, want = {}, {}
            for i, t in sorted(before):
                body = t.encode()
                gone = np.zeros(len(body), bool)
                for p in range(len(body) - 49):
                    if first.setdefault(body[p : p + 50], i) < i:
                        gone[p : p + 50] = True
                want[i] = np.frombuffer(body, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
            assert {r["doc_id"]: r["text"] for r in out.collect()} == want
        else:
            test_packing.check(out.collect(), before)
        docs = out


def test_run_packs_what_the_stages_leave(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert 0 < out.select("doc_id").distinct().count() < 200


def test_stages_on_awkward_rows(spark):
    for docs in (clashing(frame(spark, awkward())), frame(spark, [])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == docs.columns
            out.collect()


