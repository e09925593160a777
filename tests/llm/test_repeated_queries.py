"""Top-k where the rows of a query are repeated within a batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import vafile


@pytest.mark.parametrize("copies", [1, 2, 4, 8, 40])
def test_topk_with_repeated_query_rows(spark, copies):
    rng = np.random.default_rng(copies)
    x = rng.normal(size=(80, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(0, x[0].tolist())] * copies + [(i, x[i].tolist()) for i in range(1, 80)]
    got = vafile.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), F.col("vec_id") == 0).collect()
    v = np.floor(x * 256)
    want = sorted((-int(v[0] @ v[i]), i) for i in range(1, 80))[:5]
    assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == want


def test_topk_among_equal_vectors(spark):
    """Many ids and rows share the best vectors; ties go to the smaller ids, each row counts."""
    best, other = [1.0, 0.5], [0.9, 0.5]
    rows = [(i, best) for i in range(40, 0, -1)] + [(3, best)] * 3 + [(i, other) for i in range(100, 130)] + [(50, best), (50, other)]
    report = {}
    got = vafile.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), F.col("vec_id") % 50 == 0, report=report).orderBy("query_id", "rank").collect()
    first = [r["vec_id"] for r in got if r["query_id"] == 50]
    assert first == [1, 2, 3, 3, 3] and [r["vec_id"] for r in got if r["query_id"] == 100] == first
    assert report["exact"] < 60


def test_topk_reads_few_exact_vectors(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(3000, 24)))], "vec_id long, embedding array<double>")
    report = {}
    vafile.top_k(df, F.col("vec_id") % 50 == 0, report=report).collect()
    assert report["queries"] == 60 and report["exact"] <= 60 * 10  # of 180,000 pairs
