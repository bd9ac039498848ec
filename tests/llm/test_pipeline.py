import re

import corpus_pipeline
from cohortspark.llm.simhash import near_duplicates
from cohortspark.llm.toxicity import TARGET, fit, score
from tests.llm.test_decontaminate import shingles
from tests.llm.test_mixing import shared
from tests.llm.test_simhash import groups, plain

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    first = stages["toxicity"](spark, docs, FOLDER).cache()
    assert first.columns == docs.columns
    chain = fit(docs, labels)
    assert {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in score(docs, chain).collect() if r[f"p_{TARGET}"] < 0.5}
    second = stages["simhash_near_dedup"](spark, first, FOLDER).cache()
    rows = sorted((r["doc_id"], r["text"]) for r in first.collect())
    least = groups([plain(t) for _, t in rows])
    assert sorted(r["doc_id"] for r in second.collect()) == sorted({rows[i][0] for i in least})
    assert second.columns == docs.columns and near_duplicates(second).where("doc_id != component_id").count() == 0
    third = stages["benchmark_decontamination"](spark, second, FOLDER).cache()
    items = [s for s in (shingles(r["text"]) for r in bench.collect()) if s]
    clean = [r["doc_id"] for r in second.collect() if not any(len(i & shingles(r["text"])) / len(i) >= 0.8 for i in items)]
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(clean) and third.columns == docs.columns
    fourth = stages["mixing"](spark, third, FOLDER).cache()
    assert fourth.columns == docs.columns
    sizes = {}
    for r in third.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    targets, copies = shared(sizes), {}
    for r in fourth.collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    for r in third.collect():
        rate = targets[r["source"]] / sizes[r["source"]]
        assert int(rate + 1e-9) <= copies.get(r["doc_id"], 0) + 1e-9 <= min(int(rate) + 1, 3) + 1e-9
    last = stages["token_ids"](spark, fourth, FOLDER).collect()
    assert sorted(r["doc_id"] for r in last) == sorted(r["doc_id"] for r in fourth.collect())
    assert sum(r["n_tokens"] for r in last) == max(r["start"] + r["n_tokens"] for r in last)
