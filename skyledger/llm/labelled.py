"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.llm.common import bounded_sample


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, train, *, id_col: str = "doc_id", text_col: str = "text", per_class: int = 2000) -> tuple[DataFrame, dict[int, float]]:
    """(id, text, label) of at most per_class documents of label 0 and of label 1, and for each label
    how many labelled rows a sampled one stands for.

    train: a Column over id_col of labels, true for rows that may be learned from. Of repeated
    label rows the largest label holds. Ids are drawn first, so that at most 2 * per_class are broadcast;
    of documents that repeat an id, again at most per_class different ones of a label are used.
    """
    known = labels.where(train & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    sample = bounded_sample(known, "label", ["_id"], per_class)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = rows.join(F.broadcast(sample), rows["id"] == sample["_id"]).select("id", "text", "label")
    # of documents that repeat an id one is used; the limit works by task before it shuffles
    place = F.row_number().over(W.partitionBy("id").orderBy(F.xxhash64("text", F.lit(5))))
    return joined.withColumn("place", place).where(F.col("place") == 1).drop("place"), {c: max(1.0, n / per_class) for c, n in counts.items()}
