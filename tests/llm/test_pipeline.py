"""The pipeline: stages hand on the columns of documents, and each does its part on planted cases."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from skyledger.llm import decontaminate
from tests.llm.test_operators import brute_contamination


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, []
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "near_dedup":
            assert docs.select("doc_id").distinct().count() == sizes[-1] and docs.select("text").distinct().count() == sizes[-1]
        if name == "decontamination":
            long = [(i, t) for i, t in items if len(decontaminate.words(t.encode())) >= 8]
            assert all(brute_contamination(long, r["text"])[1] == 0 for r in docs.limit(40).collect())
    assert sizes[0] >= sizes[1] >= sizes[2] and sizes[3] > sizes[2] and sizes[4] == sizes[3]


def test_run_equals_stages(spark, sf):
    a, b = (sorted(map(tuple, cp.run(spark, sf).collect())) for _ in range(2))
    assert a == b and len(a) > 100


def test_empty_and_awkward(spark, tmp_path):
    from tests.llm.test_operators import LABELS, awkward, saved

    saved(awkward(spark), tmp_path)
    saved(spark.createDataFrame([(1, "nothing of it stands anywhere in these texts at all")], "item_id long, text string"), tmp_path, "benchmark")
    saved(spark.createDataFrame([], LABELS), tmp_path, "labels")
    assert cp.run(spark, str(tmp_path)).count() >= 1
    saved(awkward(spark).limit(0), tmp_path / "none")
    saved(spark.createDataFrame([], "item_id long, text string"), tmp_path / "none", "benchmark")
    assert cp.run(spark, str(tmp_path / "none")).count() == 0


def test_columns_of_any_name(spark, sf, tmp_path):
    """Columns that are named like those of the stages are carried, and change nothing else."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = ["_text", "_copy", "_scan", "_drop", "_again", "row", "rejected", "score", "of_id", "h1", "items", "copies", "_id"]
    more = docs
    for k, name in enumerate(names):
        more = more.withColumn(name, F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")))
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/a{k}")
        stage(spark, more, sf).write.parquet(f"{tmp_path}/b{k}")
        docs, more = (spark.read.parquet(f"{tmp_path}/{x}{k}") for x in "ab")
        assert sorted(map(str, docs.collect())) == sorted(map(str, more.select(*docs.columns).collect())), name
        if name != cp.STAGES[-1][0]:
            assert set(names) <= set(more.columns) and more.where(" or ".join(f"`{n}` <> '{j}:' || doc_id" for j, n in enumerate(names))).count() == 0
