"""Mixing sources to target weights with Efraimidis-Spirakis sampling, in DataFrame operations only.

Sources in code-point order, null last, weigh 3, 1, 2, repeating, and share `share` of all sizes;
no target passes `most` times its source's size, and what is above is shared anew by weight. In
closed form: the targets are min(cap, level * weight), for the one level at which they sum up.

A document is taken once for each complete epoch of its source. The rest of the target is filled by
weighted sampling without replacement: key -ln(u) / weight, smallest keys first, up to the token
budget; u comes from a hash of the id, so reruns agree. The last document is taken if at least half
of it fits. The cut is found without sorting a source: sizes are summed by the leading bits of the key,
ten more in each round, until the bucket in which the budget ends is small for every source, whatever
the weights; only that one is sorted. Then a document needs no more than its source's cut.

The weight is a document's quality as far as sizes tell it: how near the mean length of its words is to
five characters, times size / (size + 20), which prefers whole texts to scraps; each between 0.1 and 1.

Cases: null text has size 0 and is never missed or counted; a null source is a source; null ids are
hashed as empty text; repeated rows share key and fate; an empty table gives an empty result; a
source of size 0 has target 0. Ties of keys go by id. Columns beside those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.llm.common import Scratch, whole_rows

WEIGHTS = (3, 1, 2)
#: Up to so many sources, about 2 MB, their table is broadcast; else it is joined by key.
MOST_BROADCAST = 20_000


def word_count(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def quality_weight(text_col: str, size: Column) -> Column:
    length = F.length(F.coalesce(F.col(text_col), F.lit("")))
    mean = length / F.greatest(size, F.lit(1)) - 1
    return F.greatest(F.lit(0.1), 1 - F.abs(mean - 5) / 10) * F.greatest(F.lit(0.1), size / (size + F.lit(20.0)))


def sampling_columns(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(row, _id, _source, _size, _key) with the whole row in one column; _source is never null."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    size = word_count(text_col)
    return whole_rows(
        docs, _id=F.coalesce(F.col(id_col).cast("string"), F.lit("")), _source=F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")),
        _size=size, _key=-F.log(u) / quality_weight(text_col, size),
    )


#: Keys are cut to so many bits of key / (1 + key), which keeps their order; a round looks at STEP more.
BITS, STEP, SMALL = 50, 10, 20_000


def leading(level) -> Column:
    """The leading bits of the key; level is the number of rounds."""
    bits = F.floor(F.col("_key") / (1 + F.col("_key")) * float(1 << BITS)).cast("long")
    return F.floor(bits / F.pow(F.lit(2.0), BITS - STEP * level)).cast("long")


def end_buckets(slim: DataFrame, sources: DataFrame, near, scratch: Scratch) -> tuple[DataFrame, int]:
    """(_source, end): for each source with a budget the bucket of leading bits in which it ends, with
    the size before it; and the number of rounds."""
    state = sources.where("budget > 0").select("_source", "budget", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("before"))
    for level in range(1, BITS // STEP + 1):
        rows = slim.join(near(state), "_source").where(leading(level - 1) == F.col("at"))
        sums = rows.groupBy("_source", leading(level).alias("bucket")).agg(F.sum("_size").alias("size"), F.count("*").alias("n"), F.first("budget").alias("budget"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("size").over(W.partitionBy("_source").orderBy("bucket"))
        ends = sums.withColumn("upto", upto).where("upto >= budget").groupBy("_source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"), "budget", "n")).alias("end"))
        ends = scratch.save(ends, f"ends-{level}")
        if (ends.agg(F.max("end.n")).first()[0] or 0) <= SMALL:
            break
        state = ends.select("_source", "end.budget", F.col("end.bucket").alias("at"), "end.before")
    return ends, level


def source_targets(slim: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """(_source, source_size, target, epochs, budget): a row a source."""
    sizes = slim.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("n"))
    # windows without partition: over one row a source
    place = F.row_number().over(W.orderBy(F.col("_source") == "", "_source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", "_source").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy("ratio", "_source").rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "_source", "level"))).over(every)["level"])
    s = s.withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("weight")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return s.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """The documents' slim rows (_id, _source, _size, _key, and id_col), and a row a source with its
    target, epochs and the cut (cut_key, cut_id) up to which documents are taken once more."""
    scratch = Scratch(docs.sparkSession, "mix")
    slim = scratch.save(sampling_columns(docs, id_col, source_col, text_col).select(F.col("row")[id_col].alias("id"), "_id", "_source", "_size", "_key"), "sizes")
    sources = scratch.save(source_targets(slim, share, most, weights), "sources")
    n, rows = sources.agg(F.count("*"), F.sum("n")).first()
    near = F.broadcast if n <= MOST_BROADCAST else lambda x: x
    ends, level = end_buckets(slim, sources, near, scratch)
    edge = slim.join(near(ends), "_source").where(leading(level) == F.col("end.bucket"))
    edge = edge.groupBy("_source", "_key", "_id").agg(F.sum("_size").alias("size"), F.first("end").alias("end"))
    order = W.partitionBy("_source").orderBy("_key", "_id")
    half = F.col("end.before") + F.sum("size").over(order) - F.col("size") / 2.0
    edge = edge.withColumn("fits", half <= F.col("end.budget"))
    inside = edge.where("fits").groupBy("_source").agg(F.max(F.struct("_key", "_id")).alias("cut"))
    # where nothing of the last bucket fits, all smaller buckets are taken
    cuts = ends.join(inside, "_source", "left").select("_source", F.col("end.bucket").alias("cut_bucket"), F.col("cut._key").alias("cut_key"), F.col("cut._id").alias("cut_id"))
    cuts = scratch.save(sources.join(cuts, "_source", "left").select("_source", "source_size", "target", "epochs", "budget", "cut_bucket", "cut_key", "cut_id", F.lit(level).alias("level")), "cuts")
    scratch.keep_only("sizes", "cuts")
    return slim, near(cuts)


def copies() -> Column:
    """How often a document is taken, over its sampling columns joined with its source's row."""
    bucket = leading(F.col("level"))
    inside = F.struct("_key", "_id") <= F.struct(F.col("cut_key").alias("_key"), F.col("cut_id").alias("_id"))
    once = (bucket < F.col("cut_bucket")) | ((bucket == F.col("cut_bucket")) & F.col("cut_key").isNotNull() & inside)
    return F.col("epochs") + F.when(F.coalesce(once, F.lit(False)), 1).otherwise(0)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    slim, sources = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = slim.join(sources, "_source")
    return joined.select(F.col("id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (copies() * F.col("_size")).cast("long").alias("taken"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
k AS (SELECT doc_id, source, size,
        -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
        / (greatest(0.1, 1 - abs(CAST(length(t) AS DOUBLE) / greatest(size, 1) - 1 - 5) / 10) * greatest(0.1, CAST(size AS DOUBLE) / (size + 20.0))) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, ([3.0, 1.0, 2.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
r AS (SELECT source, source_size, CAST(w AS DOUBLE) AS w, 2 * source_size AS cap, 2 * source_size / CAST(w AS DOUBLE) AS ratio FROM s),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap, w * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS FIRST LIMIT 1)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
o AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
        sum(size) OVER (PARTITION BY k.source ORDER BY key, CAST(doc_id AS VARCHAR)) AS upto FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (epochs + CASE WHEN budget > 0 AND upto - size / 2.0 <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it.

    Texts without a word have size 0 and stay or go with their key. A null source is a source; rows
    without id are one id; repeated rows are taken alike. All columns are carried, whatever their names.
    """
    _, sources = mix_plan(docs)
    rows = sampling_columns(docs, "doc_id", "source", "text").select("row", "_id", "_source", "_key")
    taken = rows.join(sources, "_source").withColumn("copies", copies().cast("int")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
