"""Classes of texts whose sets of shingles have a Jaccard similarity of at least a bound, exactly.

1. Texts of equal sets of shingles become one node, named by the XXH64 of the set's sorted hashes.
2. Every set is put into one order for all: shingles frequent in a sample last, then by hash. Two
   sets of similarity t share a shingle within their first size - ceil(t * size) + 1 ones (prefix
   filter), and at their first common one neither set has too little left (positional filter).
3. Where links by another method are given (`first`: the fingerprints of simhash.py), they are tested
   first, as in step 5, and groups of nodes that they bind to one component need not meet again.
4. Nodes meet by shingle. In small groups all pairs are candidates. A large group is first met by
   stars around single nodes, of components drawn anew in each round, for as long as rounds join
   many components; then all pairs whose ends are not yet in one component are candidates, so that no pair
   that could join two classes stays untested.
5. Candidates differ in few of 256 parities of their hashes, which bounds the overlap from above. Of
   different pairs, longer sketches of parities, of two bits a shingle and more, are compared in the
   same way; they let through little below a similarity of 0.75. What is left is tested on the sets,
   worked out again from the texts of the nodes that have such a candidate.
6. Connected components over the pairs that pass.

No step leaves out a pair at or over the bound, but for equal 64-bit hashes of unlike shingles or sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.llm.common import Scratch, map_rows, near, release, text_bytes
from skyledger.llm.components import connected_components

SEED = 42
PARITIES = [f"b{k}" for k in range(4)]


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    import xxhash

    words = text.lower().split() if text else []  # bytes.lower() and split() know ASCII only
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = [join(words)] * bool(words) if len(words) <= size else map(join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.array([digest(x, SEED) for x in shingles], np.uint64)


def frequent(rows: DataFrame, size: int, sampled: int = 20_000, least: int = 20, most: int = 65_536) -> np.ndarray:
    """Hashes of the shingles that at least `least` of about `sampled` texts hold, rarest first. Only
    the cost hangs on them."""
    share = min(1.0, sampled / max(rows.count(), 1))

    def run(batches):
        for batch in batches:
            for t in text_bytes(batch["text"]):
                yield pa.record_batch({"h": pa.array(np.unique(shingle_hashes(t, size)).view(np.int64))})
            release()

    drawn = rows.select("text").distinct().where(F.pmod(F.xxhash64("text", F.lit(29)), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = drawn.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(most).toArrow()
    return found["h"].to_numpy()[::-1].view(np.uint64)


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the hashes by their low bits, as bytes: a power of two of bits, two a hash at least."""
    bits = 1 << max(8, (2 * len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)


def folded(s: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same hashes in so many bytes, a half, a quarter, … of its own."""
    while len(s) > size:
        s = s[: len(s) // 2] ^ s[len(s) // 2 :]
    return s


def prefixes(rows: DataFrame, size: int, least: float, late: np.ndarray, first=None) -> DataFrame:
    """(id, text_hash, node, size, sketch, parities, the columns of `first`, prefix) for rows of id and text."""
    words = first.columns if first else []
    shared = rows.sparkSession.sparkContext.broadcast((np.sort(late), np.argsort(late, kind="stable")))

    def make():
        import xxhash

        sorted_late, rank = shared.value

        def one(t: bytes | None) -> tuple[int, int, np.ndarray, np.ndarray, list[int]]:
            h = shingle_hashes(t, size)
            own = first.words(h) if first else []
            h = np.unique(h)
            parities = sketch(h)
            order = h
            if len(sorted_late) and len(h):
                at = np.minimum(np.searchsorted(sorted_late, h), len(sorted_late) - 1)
                is_late = sorted_late[at] == h
                behind = h[is_late][np.argsort(rank[at[is_late]], kind="stable")]
                order = np.concatenate([h[~is_late], behind])
            return xxhash.xxh64_intdigest(h.tobytes(), SEED), len(h), parities, order[: len(h) - math.ceil(least * len(h) - 1e-6) + 1].view(np.int64), own

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [one(t) for t in text_bytes(batch["text"])]
            node = np.array([g[0] for g in got], np.uint64).view(np.int64)
            parity = np.array([folded(g[2], 32).view(np.int64) for g in got], np.int64).reshape(-1, 4)
            out = {"id": batch["id"], "text_hash": batch["text_hash"], "node": pa.array(node), "size": pa.array([g[1] for g in got], pa.int32()), "sketch": pa.array([g[2].tobytes() for g in got], pa.binary())}
            out |= {b: pa.array(np.ascontiguousarray(parity[:, k])) for k, b in enumerate(PARITIES)}
            own = np.array([g[4] for g in got], np.uint64).view(np.int64).reshape(-1, len(words)) if words else None
            out |= {c: pa.array(np.ascontiguousarray(own[:, k])) for k, c in enumerate(words)}
            return pa.record_batch(out | {"prefix": pa.array([g[3] for g in got], pa.list_(pa.int64()))})

        return f

    return map_rows(rows.select("id", F.xxhash64("text").alias("text_hash"), "text"), make, "id long, text_hash long, node long, size int, sketch binary, " + ", ".join(f"{b} long" for b in [*PARITIES, *words]) + ", prefix array<long>")


def row_id(c: Column) -> Column:
    """The id as a long; rows without one come after all others."""
    return F.coalesce(c.cast("long"), F.lit((1 << 63) - 1))


def could_pass(least: float) -> Column:
    """Over candidates a and b that meet by a shingle: the positional and the parity filter."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    total = (a("size") + b("size")).cast("double")
    left = F.least(a("size") - a("pos"), b("size") - b("pos"))  # the shared shingle and what stands behind
    unlike = sum((F.bit_count(a(p).bitwiseXOR(b(p))) for p in PARITIES), F.lit(0))
    enough = F.lit(least) * total - 1e-6
    return (left * (1 + least) >= enough) & ((total - unlike) / 2 * (1 + least) >= enough)


def likely(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs that their sketches do not rule out."""
    a, b = (sketches.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("sketch").alias(f"sketch_{n}")) for n in "uv")
    both = pairs.join(a, "u").join(b, "v").select("u", "v", "size_u", "size_v", "sketch_u", "sketch_v")

    def run(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch[c].to_pylist() for c in ("size_u", "size_v", "sketch_u", "sketch_v")), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                short = min(len(x), len(y))
                unlike = int(np.bitwise_count(folded(x, short) ^ folded(y, short)).sum(dtype=np.int64))
                keep.append((n + m - unlike) / 2 * (1 + least) >= least * (n + m) - 1e-6)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def passing(pairs: DataFrame, nodes: DataFrame, sketches: DataFrame, rows: DataFrame, size: int, least: float, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (u, v) of nodes whose sets have the similarity."""
    pairs = scratch.save(likely(scratch.save(pairs.distinct(), f"met-{name}"), sketches, least), f"pairs-{name}")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes, "node")
    ends = scratch.save(ends.select("node", F.col("id").alias("_id"), F.col("text_hash").alias("_text")), f"ends-{name}")
    texts = rows.join(near(ends), (F.col("id") == F.col("_id")) & (F.xxhash64("text") == F.col("_text")))

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [np.unique(shingle_hashes(t, size)).view(np.int64) for t in text_bytes(batch["text"])]
            return pa.record_batch({"node": batch["node"], "h": pa.array(sets, pa.list_(pa.int64()))})

        return f

    # One shuffle of the sets serves both joins; it also leaves one of repeated rows.
    sets = map_rows(texts.select("node", "text"), make, "node long, h array<long>").dropDuplicates(["node"])
    a, b = sets.select(F.col("node").alias("u"), F.col("h").alias("a")), sets.select(F.col("node").alias("v"), F.col("h").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    either = F.size("a") + F.size("b") - both
    return scratch.save(pairs.join(a.hint("merge"), "u").join(b.hint("merge"), "v").where(both >= least * either).select("u", "v"), f"passed-{name}")


def similar_classes(docs: DataFrame, id_col: str, text_col: str, *, size: int = 5, least: float = 0.8, small: int = 48, stars: int = 3, first=None) -> DataFrame:
    """(id, text_hash, component), a row for each row; text_hash is xxhash64 of the text, id as row_id has it.

    first gives links to start with: words(h) of a text's shingle hashes as its columns, and edges() over
    the nodes' words. small and stars only choose how pairs are met, not which: whatever they and first
    are, no pair whose ends are not in one component by then stays untested.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = docs.select(row_id(F.col(id_col)).alias("id"), F.col(text_col).alias("text"))
    found = scratch.save(prefixes(rows, size, least, frequent(rows, size), first), "prefixes")
    nodes = scratch.save(found.groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("row")).select("node", "row.*"), "nodes")
    of_node = found.join(near(nodes.select(F.col("id").alias("_id"), F.col("text_hash").alias("_text"))), (F.col("id") == F.col("_id")) & (F.col("text_hash") == F.col("_text")), "left_semi").drop("id", "text_hash")
    met = of_node.select(F.posexplode("prefix").alias("pos", "shingle"), "node", "size").withColumn("n", F.count("*").over(W.partitionBy("shingle"))).where("n > 1")
    met = scratch.save(met, "met")
    bits = of_node.select("node", *PARITIES).join(near(scratch.save(met.select("node").distinct(), "meeting")), "node", "left_semi").dropDuplicates(["node"])
    met = scratch.save(met.join(bits, "node"), "groups")
    sketches = scratch.save(of_node.select("node", "size", "sketch").dropDuplicates(["node"]).join(near(scratch.spark.read.parquet(scratch.path("meeting"))), "node", "left_semi"), "sketches")
    scratch.drop("met")

    def all_pairs(groups: DataFrame, *apart: Column) -> DataFrame:
        test = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.node") < F.col("b.node")) & could_pass(least)
        for c in apart:
            test = test & c
        return groups.alias("a").join(groups.alias("b"), test).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))

    def star(groups: DataFrame, *orders: int) -> DataFrame:
        """For each order, the nodes of a group with that of its first component's first node. Groups have
        eight orders at a time, so that groups of the same nodes do not all draw the same one."""
        drawn = lambda k: F.struct(F.xxhash64("component", F.lit(k), F.col("shingle") % 8), F.xxhash64("node", F.lit(k)))
        end = F.struct("node", "size", "pos", "component", *PARITIES)
        hubs = groups.groupBy("shingle").agg(F.array_distinct(F.array(*[F.min_by(end, drawn(k)) for k in orders])).alias("hubs"))
        ends = F.col("a.node"), F.col("b.node")
        met = groups.alias("b").join(hubs.select("shingle", F.explode("hubs").alias("a")), "shingle")
        return met.where((F.col("a.component") != F.col("b.component")) & could_pass(least)).select(F.least(*ends).alias("u"), F.greatest(*ends).alias("v"))

    def still_open(groups: DataFrame, of: DataFrame, k: int) -> DataFrame:
        """The groups that hold several components, with each node's component."""
        known = groups.join(of.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(*groups.columns, F.coalesce("component", "node").alias("component"))
        split = known.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle")
        return scratch.save(known.join(split, "shingle", "left_semi"), f"open-{k}")

    data = (nodes, sketches, rows, size, least, scratch)
    if first:
        linked = passing(first.edges(found.select("node", *first.columns), scratch), *data, "links")
        known = still_open(met, connected_components(linked, Scratch(docs.sparkSession, "jaccard-0")), 0)
        left, edges = known.drop("component"), linked.union(passing(star(known.where("n > 2"), 0), *data, "0"))
    else:
        left, edges = met, passing(star(met.where("n > 2").withColumn("component", F.col("node")), 0), *data, "0")
    before, k = 0, 0
    while True:
        k += 1
        of = connected_components(edges, Scratch(docs.sparkSession, f"jaccard-{k}"))
        if before == "final":
            break
        known = still_open(left, of, k)
        scratch.drop(f"open-{k - 1}")
        if known.isEmpty():
            break
        # pairs that are apart, and components, over the large groups
        sums = known.where(F.col("n") > small).groupBy("shingle", "component").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("within"))
        apart_pairs, members = sums.agg(F.sum((F.col("n") * F.col("n") - F.col("within")) / 2), F.sum("n")).first()
        state = known.where(F.col("n") > small).select("component").distinct().count()
        apart = F.col("a.component") != F.col("b.component")
        if k >= stars and (before - state < state / 50 or (apart_pairs or 0) <= 2 * (members or 0)):
            before, pairs = "final", all_pairs(known, apart)
        else:
            before, pairs = state, all_pairs(known.where(F.col("n") <= small), apart).union(star(known.where(F.col("n") > small), 2 * k, 2 * k + 1))
        edges = edges.union(passing(pairs, *data, str(k)))
        left = known.where(F.col("n") > small).drop("component")
    of = scratch.save(of.withColumnRenamed("node", "_node"), "components")
    scratch.keep_only("prefixes", "components")
    return found.join(of, found["node"] == of["_node"], "left").select("id", "text_hash", F.coalesce("component", "node").alias("component"))
