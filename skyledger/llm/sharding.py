"""Sharding by balanced label propagation, in DataFrame operations only.

Linked documents (those of one group, such as equal texts) should share a shard, while the shards'
sizes in bytes stay near equal: the law is `bytes`.

1. Documents fall by a hash of their id into 64 cells of their group, and start in shard cell mod 8.
   A cell of more than a 512th of all rows is split by row, so cells stay small however large a group
   is, and whether or not its rows have ids of their own. Rows and bytes are summed up by cell.
2. Rounds of label propagation: each cell wants the shard that holds most of its group's rows, ties
   by a preference of the group's own. Wishes are admitted in the order of their gain, as far as the
   prefix sum of bytes keeps within the shard's quota; sums are taken by gain class and hash, not
   by sorting. Rounds go on until none is admitted; cells only move to where most of their group is,
   so that comes about.
3. Shards over their fair share give cells of the least gain back. These and the cells of unlinked
   documents are laid out in a few classes of size, largest first: each class fills the shards up to
   a common level, by intervals of its prefix sums. After the last class, of the smallest documents,
   sizes differ by about one of these. Groups of more than a quarter of a fair share are laid out
   by the cell, smaller ones as a whole.
4. Slots number a shard's documents from 0 without gaps, by hash buckets with offsets.

Cases: null text has no bytes, counts 1, and is no group: null texts are not linked. Empty texts
are one group. Repeated rows and ids are separate documents of equal text. Null ids are hashed like
an id of their own; null texts without id count as one group. Fewer documents than shards leave shards empty; an empty table gives an empty
result. Columns beside those named are not read.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.llm.common import Scratch

CELLS, MOST_CELLS = 64, 512
GROUP = ["g", "crc", "size"]


def slim_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, g, crc, size, cell): the group is told by two hashes and the size, null for null texts by the id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        F.when(F.col(text_col).isNull(), F.xxhash64(F.lit("null"), F.col(id_col))).otherwise(F.xxhash64(text)).alias("g"),
        F.crc32(text.cast("binary")).alias("crc"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(CELLS)).cast("int").alias("cell"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)).cast("int").alias("salt"),  # fixed once the rows are written
    )


def split_cells(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with the cells of more than a MOST_CELLS-th of all rows split; there are fewer such cells than that."""
    total = counts.agg(F.sum("rows")).first()[0] or 0
    hot = counts.where(F.col("rows") * MOST_CELLS > total).select(*GROUP, "cell", F.ceil(F.col("rows") * MOST_CELLS / F.lit(total)).cast("int").alias("parts"))
    if hot.isEmpty():
        return rows
    joined = rows.join(F.broadcast(hot), [*GROUP, "cell"], "left")
    return joined.withColumn("cell", F.col("cell") + CELLS * F.coalesce(F.col("salt") % F.col("parts"), F.lit(0))).select(*rows.columns)


def loads(placed: DataFrame, shards: int) -> list[int]:
    out = [0] * shards
    for s, n in placed.groupBy("shard").agg(F.sum("bytes")).collect():  # a row a shard
        out[s] = int(n)
    return out


def fill(level_of: list[float], total: float) -> list[float]:
    """What each shard gets of total, so that the lowest are raised to a common level."""
    order, level = sorted(level_of), 0.0
    for k in range(1, len(order) + 1):
        level = (total + sum(order[:k])) / k
        if k == len(order) or level <= order[k]:
            break
    return [max(0.0, level - x) for x in level_of]


def propagate(linked: DataFrame, shards: int, quota: float, scratch: Scratch) -> DataFrame:
    """linked: cells of groups with several rows, with their shard; they move as far as quotas allow."""
    for k in itertools.count():
        held = linked.groupBy(*GROUP, "shard").agg(F.sum("rows").alias("held"))
        liking = -F.pmod(F.col("shard") - F.col("g"), F.lit(shards))
        best = held.groupBy(*GROUP).agg(F.max(F.struct("held", liking.alias("liking"), F.col("shard").alias("want"))).alias("best"))
        wishes = linked.join(best, GROUP).join(held, [*GROUP, "shard"]).withColumn("want", F.col("best.want"))
        gain = F.col("best.held") - F.col("held")
        # 16 classes of gain, largest first, and 256 hashes within each
        rank = (15 - F.least(F.lit(15), F.floor(F.log2(gain + 1.0)))) * 256 + F.pmod(F.xxhash64(*GROUP, "cell"), F.lit(256))
        wishes = wishes.withColumn("rank", F.when(F.col("want") != F.col("shard"), rank).cast("int")).select(*linked.columns, "want", "rank")
        room = F.element_at(F.array(*[F.lit(float(max(0.0, quota - x))) for x in loads(linked, shards)]), F.col("want") + 1)
        sums = wishes.where("rank is not null").groupBy("want", "rank").agg(F.sum("bytes").alias("bytes"))
        upto = F.sum("bytes").over(W.partitionBy("want").orderBy("rank"))
        admitted = sums.withColumn("upto", upto).where(F.col("upto") <= room).select("want", "rank", F.lit(True).alias("moves"))  # at most 8 x 4096 rows
        moved = wishes.join(F.broadcast(admitted), ["want", "rank"], "left").withColumn("moves", F.coalesce("moves", F.lit(False)))
        moved = moved.withColumn("shard", F.when(F.col("moves"), F.col("want")).otherwise(F.col("shard")))
        linked = scratch.save(moved.select(*linked.columns, "moves").withColumn("moves", F.col("moves")), f"round-{k}")
        n = linked.where("moves").count()
        linked = linked.drop("moves")
        if k:
            scratch.drop(f"round-{k - 1}")
        if not n:
            break
    return linked


def give_back(linked: DataFrame, shards: int, fair: float) -> DataFrame:
    """Adds `free`: true for cells, of the smallest groups first, that a shard over its fair share gives up."""
    over = [x - fair for x in loads(linked, shards)]
    if max(over) <= 0:
        return linked.withColumn("free", F.lit(False))
    rank = F.least(F.lit(15), F.floor(F.log2(F.col("grows").cast("double")))) * 256 + F.pmod(F.xxhash64(*GROUP, "unit"), F.lit(256))
    ranked = linked.withColumn("rank", rank.cast("int"))
    sums = ranked.groupBy("shard", "rank").agg(F.sum("bytes").alias("bytes"))
    before = F.sum("bytes").over(W.partitionBy("shard").orderBy("rank")) - F.col("bytes")
    too_much = F.element_at(F.array(*[F.lit(float(x)) for x in over]), F.col("shard") + 1)
    given = sums.where(too_much > 0).withColumn("before", before).where(F.col("before") < too_much).select("shard", "rank", F.lit(True).alias("free"))  # at most 8 x 4096 rows
    return ranked.join(F.broadcast(given), ["shard", "rank"], "left").withColumn("free", F.coalesce("free", F.lit(False))).drop("rank")


def size_classes(free: DataFrame) -> list[tuple[int, int]]:
    """Ranges of log2(bytes), largest first, each of a factor of 8 in size; the fifth takes the rest."""
    by = dict(free.groupBy(F.floor(F.log2("bytes")).cast("int")).agg(F.sum("bytes")).collect())  # a row a power of two
    out, high = [], max(by, default=-1)
    while high >= min(by, default=0):
        low = high - 2 if len(out) < 4 else min(by)
        if any(low <= c <= high for c in by):
            out.append((low, high))
        high = low - 1
    return out


def lay_out(free: DataFrame, start: list[int], shards: int, fair: float, scratch: Scratch) -> DataFrame:
    """Gives the items their shard: those over a sixteenth of a fair share, of which there can be no
    more than 16 a shard, one by one to the emptiest; the others class by class."""
    now = [float(x) for x in start]
    columns = [*GROUP, "unit", "bytes", "shard"]
    huge = []
    for r in sorted(free.where(F.col("bytes") > fair / 16).select(*columns[:-1]).collect(), key=lambda r: (-r["bytes"], *r)):
        s = now.index(min(now))
        now[s] += r["bytes"]
        huge.append((*r, s))
    kind = "array<struct<g:bigint,crc:bigint,size:bigint,unit:int,bytes:bigint,shard:int>>"
    rows = F.from_json(F.lit(json.dumps([dict(zip(columns, map(int, x), strict=True)) for x in huge])), kind)
    placed = free.sparkSession.range(1).select(F.inline(rows))
    free = free.where(F.col("bytes") <= fair / 16)
    n = free.count()
    buckets = max(16, n // 20_000)
    h = F.xxhash64(*GROUP, "unit", F.lit(7))
    for k, (low, high) in enumerate(size_classes(free)):
        items = free.where(F.floor(F.log2("bytes")).between(low, high)).withColumns({"bucket": F.pmod(h, F.lit(buckets)), "h": h})
        sums = items.groupBy("bucket").agg(F.sum("bytes").alias("sum"))
        starts = sums.select("bucket", (F.sum("sum").over(W.orderBy("bucket")) - F.col("sum")).alias("start"))  # a row a bucket of 20,000 items
        within = F.sum("bytes").over(W.partitionBy("bucket").orderBy("h", *GROUP, "unit").rowsBetween(W.unboundedPreceding, 0))
        middle = F.col("start") + F.col("within") - F.col("bytes") / 2.0
        ends, total = [], 0.0
        for share in fill(now, float(items.agg(F.sum("bytes")).first()[0] or 0)):
            total += share
            ends.append(total)
        shard = F.lit(max((s for s in range(shards) if ends[s] > (ends[s - 1] if s else 0)), default=0))
        for s in reversed(range(shards)):
            shard = F.when(middle < ends[s], s).otherwise(shard) if ends[s] > (ends[s - 1] if s else 0) else shard
        got = items.withColumn("within", within).join(starts, "bucket").withColumn("shard", shard.cast("int"))
        got = scratch.save(got.select(*columns), f"class-{k}")
        now = [a + b for a, b in zip(now, loads(got, shards), strict=True)]
        placed = placed.unionByName(got)
    return placed


def balanced_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", *, slack: float = 0.25) -> DataFrame:
    """(id, size, crc, shard, slot), a row for each document."""
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.save(slim_rows(docs, id_col, text_col), "rows")
    rows = split_cells(rows, scratch.save(rows.groupBy(*GROUP, "cell").agg(F.count("*").alias("rows")), "counts"))
    group = W.partitionBy(*GROUP)
    cells = rows.groupBy(*GROUP, "cell").agg(F.count("*").alias("rows"))
    cells = cells.withColumns({"bytes": F.col("rows") * F.col("size"), "grows": F.sum("rows").over(group)})
    cells = scratch.save(cells.withColumn("shard", (F.col("cell") % shards).cast("int")), "cells")
    n, total = cells.agg(F.sum("rows"), F.sum("bytes")).first()
    fair = (total or 0) / shards
    linked = propagate(cells.where("grows > 1"), shards, fair * (1 + slack), scratch)
    # Groups of up to a quarter of a fair share move as a whole from here, larger ones by the cell.
    unit = F.when(F.col("grows") * F.col("size") > fair / 4, F.col("cell")).otherwise(-1)
    linked = scratch.save(give_back(linked.withColumn("unit", unit), shards, fair), "linked")
    # a small group that quotas left cut is laid out as a whole
    cut = (F.col("unit") == -1) & (F.min("shard").over(group) < F.max("shard").over(group))
    linked = scratch.save(linked.withColumn("free", F.col("free") | cut), "settled")
    merged = linked.where("free").groupBy(*GROUP, "unit").agg(F.sum("bytes").alias("bytes"))
    single = cells.where("grows = 1").select(*GROUP, F.col("cell").alias("unit"), "bytes")
    free = scratch.save(merged.unionByName(single), "free")
    placed = lay_out(free, loads(linked.where("not free"), shards), shards, fair, scratch)
    stay = linked.where("not free").select(*GROUP, "cell", "shard")
    moved = linked.where("free").select(*GROUP, "cell", "unit").join(placed, [*GROUP, "unit"]).select(*GROUP, "cell", "shard")
    alone = placed.join(cells.where("grows = 1").select(*GROUP, "cell"), GROUP, "left_semi").select(*GROUP, F.col("unit").cast("int").alias("cell"), "shard")
    final = scratch.save(rows.join(stay.unionByName(moved).unionByName(alone), [*GROUP, "cell"]).select("id", "size", "crc", "shard"), "final")
    scratch.keep_only("final")
    buckets = max(4, (n or 0) // shards // 20_000)
    bucket = F.pmod(F.xxhash64("id", "crc", F.lit(3)), F.lit(buckets))
    sums = final.groupBy("shard", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    offset = F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")
    place = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("id", "crc", "size")) - 1
    slots = final.withColumn("bucket", bucket).withColumn("place", place).join(sums.select("shard", "bucket", offset.alias("offset")), ["shard", "bucket"])
    return slots.select("id", "size", "crc", "shard", (F.col("offset") + F.col("place")).cast("long").alias("slot"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    found = balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharding_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: doc_id, size, text_crc32, shard and slot of every row."""
    found = balanced_shards(docs)
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", "slot")
