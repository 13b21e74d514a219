"""Every stage on its own input, against plain versions of its rule."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from burnish.llm import toxicity
from burnish.llm.common import written

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    bench = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(P.STAGES):
        out = written(stage(spark, docs, FOLDER), name)
        before = {r["doc_id"]: r for r in docs.collect()}
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before) and len(after) == out.count()
        if i < len(P.STAGES) - 1:
            assert out.columns == columns
        if name == "toxicity":
            labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
            model = toxicity.fit(docs, labels)
            low = toxicity.score(docs, model).where(F.col("score") < 0.5)
            assert set(after) == {r["doc_id"] for r in low.collect()}
        if name == "near_duplicates":
            texts = [" ".join(r["text"].lower().split()) for r in after.values()]
            assert len(texts) == len(set(texts))
            first = {}
            for r in sorted(before.values(), key=lambda r: r["doc_id"]):
                first.setdefault(r["text"], r["doc_id"])
            assert set(after) <= set(first.values())
        if name == "decontamination":
            assert not any(b in r["text"] for r in after.values() for b in bench)
            gone = set(before) - set(after)
            held = {i for i, r in before.items() if any(b in r["text"] for b in bench)}
            assert held <= gone
        if name == "personal_data":
            assert set(after) == set(before)
            assert not any("@mail" in r["text"] for r in after.values())
        if name == "mixing":
            for r in after.values():
                assert 0 <= r["taken"] <= 2 * r["size"] and r["copies"] > 0
        docs = out


def test_whole_run_and_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        rows.where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    assert P.run(spark, FOLDER).count() > 0
