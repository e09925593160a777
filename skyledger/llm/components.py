"""Connected components by alternating large-star and small-star rounds, each round written."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import Scratch

#: Up to so many edges, about 2 MB, a round is one task without a shuffle; beyond, rounds are dealt out by node.
#: Each shuffle and broadcast costs the driver a plan's step and, for a minute, a thread.
FEW_EDGES = 100_000


def connected_components(edges: DataFrame, scratch: Scratch, few: int = FEW_EDGES) -> DataFrame:
    """edges(u, v) of long ids -> (node, component): the smallest id reachable, for every node named.

    Every round has two joins or groupings over slim rows; hubs are met by partial aggregation and,
    in the join, by the engine's splitting of skewed partitions. Rounds go on until one changes
    nothing; edges only ever lead to smaller ids and never become more, so that comes about, in about
    log(n) rounds. An empty input gives no rows. few only chooses where rounds run, not their result.
    """
    u, v = F.col("u"), F.col("v")
    now = scratch.save(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "cc-0")
    in_one = now.count() <= few
    one = (lambda d: d.coalesce(1)) if in_one else (lambda d: d)  # said again behind joins, where the engine forgets it
    met = (lambda d: d.hint("merge")) if in_one else (lambda d: d)
    seen = None
    for k in itertools.count(1):
        both = one(now).select(F.inline(F.array(F.struct(u.alias("u"), v.alias("v")), F.struct(v.alias("u"), u.alias("v")))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: all larger neighbours, and u itself, go to the least neighbour of u
        large = one(both.join(met(least), "u").where("v > u").select(v.alias("u"), F.col("m").alias("v")).where("u <> v")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = one(large.join(met(low), "u")).select(F.explode(F.array(F.struct(u.alias("u"), F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = scratch.save(small, f"cc-{k}")
        scratch.drop(f"cc-{k - 1}")
        state = one(now).agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    nodes = now.select(u.alias("node"), v.alias("component"))
    return nodes.union(now.select(v.alias("node"), v.alias("component")).distinct())
