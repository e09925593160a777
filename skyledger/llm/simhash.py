"""SimHash near-duplicate groups, found by the generalised pigeonhole principle.

1. A fingerprint of 64 bits for each text: a bit is set if over half of the shingles' XXH64 have it.
2. Equal fingerprints become one node, named by the smallest document id.
3. From bit and bit-pair counts over all nodes, correlated bits are grouped into partitions, and a
   dynamic programme allocates a threshold t to each so that the t + 1 sum to radius + 1, at the
   least estimated cost of signatures and candidate pairs. Two fingerprints within the radius then
   differ by at most t in some partition (t = -1: the partition is not probed), and so share a
   signature: the partition without some t of its bits.
4. Nodes meet by signature. Candidates are verified by XOR and bit count, in numpy and in place; a
   group gives the edges of a spanning forest, never its pairs. Groups beyond `block` nodes are cut
   into chunks, and each pair of chunks meets in a group of its own.
5. Connected components over the edges.

Cases: null and empty texts have no shingle and fingerprint zero, linked like any other. Repeated
rows and repeated ids are kept, and fall into one group if their texts are equal. Rows with null id
are kept and get the component of their fingerprint, null if it holds no other id. An empty table
gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import Scratch, map_rows, near, text_bytes, whole_rows
from skyledger.llm.components import connected_components
from skyledger.llm.jaccard import row_id, shingle_hashes, similar_classes

BITS = 64


#: Odd multipliers that turn a shingle's hash into independent ones, for the guard words.
MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
GUARDS = [f"g{k}" for k in range(len(MIXERS))]


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(h), 65536):
        ones += np.unpackbits(h[start : start + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def words_of(h: np.ndarray, guards: bool = False) -> list[int]:
    """The fingerprint of a text's shingles, repeats included, and behind it the guard words if asked for."""
    if not len(h):
        return [0] * (1 + len(MIXERS) * guards)
    out = [majority(h)]
    for m in MIXERS if guards else ():
        x = h * np.uint64(m)
        out.append(majority((x ^ (x >> np.uint64(29))) * np.uint64(MIXERS[0])))
    return out


def fingerprint(text: bytes | None, size: int, guards: bool = False) -> list[int]:
    return words_of(shingle_hashes(text, size), guards)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int, guards: bool) -> DataFrame:
    """(id, fp, guard words): as signed longs with the bits."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    names = ["fp", *GUARDS[: len(GUARDS) * guards]]

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = np.array([fingerprint(t, size, guards) for t in text_bytes(batch["text"])], np.uint64).view(np.int64)
            return pa.record_batch({"id": batch["id"]} | {n: pa.array(np.ascontiguousarray(words[:, k])) for k, n in enumerate(names)})

        return f

    return map_rows(rows, make, "id long, " + ", ".join(f"{n} long" for n in names))


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits how many have both (a bit with itself: ones)."""

    def run(batches):
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            for start in range(0, len(fp), 8192):
                x = np.unpackbits(fp[start : start + 8192], axis=1, bitorder="little").astype(np.float32)
                both += (x.T @ x).astype(np.int64)
            n += len(fp)
        if n:
            yield pa.record_batch({"i": pa.array(np.arange(-1, BITS), pa.int32()), "n": pa.array([[n] + [0] * (BITS - 1), *both.tolist()], pa.list_(pa.int64()))})

    rows = nodes.select("fp").mapInArrow(run, "i int, n array<long>")
    sums = rows.groupBy("i").agg(*[F.sum(F.col("n")[j]).alias(f"n{j}") for j in range(BITS)]).collect()  # 65 rows
    by = {r["i"]: list(r)[1:] for r in sums}
    return (by[-1][0], np.array([by[i] for i in range(BITS)], float)) if by else (0, np.zeros((BITS, BITS)))


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near-equal width; each takes the bits that correlate most with those it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        while len(group) < width:
            group.append(max((b for b in free if b not in group), key=lambda b: (corr[b, group].sum(), -b)))
        free = [b for b in free if b not in group]
        out.append(sorted(group))
    return out


def agreement(n: int, both: np.ndarray, bits: list[int]) -> list[float]:
    """Estimated chance that two fingerprints agree on all but t of the bits, by t = 0, 1, 2, 3.

    Bits are chained by their strongest dependence; a chance for each follows from the pair counts.
    """
    if not n:
        return [1.0] * 4
    p1 = np.diag(both) / n
    same = p1**2 + (1 - p1) ** 2

    def pair(i: int, j: int) -> float:
        q = both[i, j] / n
        return q**2 + (p1[i] - q) ** 2 + (p1[j] - q) ** 2 + (1 - p1[i] - p1[j] + q) ** 2

    chain, rest = [bits[0]], set(bits[1:])
    chance = [same[bits[0]]]
    while rest:
        j, i = max(((j, i) for j in rest for i in chain), key=lambda x: (pair(*x) / (same[x[0]] * same[x[1]]), -x[0], -x[1]))
        chance.append(min(1.0, pair(j, i) / same[i]))
        chain.append(j)
        rest.remove(j)
    chance.sort()
    return [float(np.prod(chance[t:] if t < len(chance) else [1.0])) for t in range(4)]  # the most selective bits are left out: an upper estimate


def allocate(n: int, both: np.ndarray, radius: int, row_cost: float = 500.0, most_rows: int = 128) -> list[tuple[list[int], int]]:
    """Partitions with thresholds of the least estimated cost: candidate pairs plus row_cost for each
    signature, of at most most_rows for each fingerprint."""
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for parts in range(1, radius + 3):
        groups = group_bits(n, both, parts)
        # at[s]: least cost, signatures and thresholds of the groups so far with sum of t + 1 equal to s
        at: dict[int, tuple[float, int, list[int]]] = {0: (0.0, 0, [])}
        for bits in groups:
            chance, new = agreement(n, both, bits), {}
            for s, (cost, rows, ts) in at.items():
                for t in range(-1, min(3, radius - s, len(bits) - 1) + 1):
                    signatures = math.comb(len(bits), t) if t >= 0 else 0
                    more = signatures * (n * row_cost + n * n / 2 * chance[t]) if t >= 0 else 0.0
                    option = (cost + more, rows + signatures, [*ts, t])
                    if option[1] <= most_rows and (s + t + 1 not in new or option < new[s + t + 1]):
                        new[s + t + 1] = option
            at = new
        if radius + 1 in at and at[radius + 1][0] < best[0]:
            best = (at[radius + 1][0], [(g, t) for g, t in zip(groups, at[radius + 1][2], strict=True) if t >= 0])
    if not best[1]:
        raise ValueError(f"no allocation for radius {radius} within {most_rows} signatures")
    return best[1]


def signatures(nodes: DataFrame, allocation: list[tuple[list[int], int]]) -> DataFrame:
    """(probe, sig, fp, id, guard words): for each partition and each choice of t of its bits, the others."""
    masks, rest = [], [c for c in nodes.columns if c != "fp"]
    for bits, t in allocation:
        whole = sum(1 << b for b in bits)
        masks += [whole & ~sum(1 << b for b in drop) for drop in itertools.combinations(bits, t)]

    def run(batches):
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for k, mask in enumerate(masks):
                yield pa.record_batch({"probe": pa.array(np.full(len(fp), k, np.int32)), "sig": pa.array((fp & np.uint64(mask)).view(np.int64)), "fp": batch["fp"]} | {c: batch[c] for c in rest})

    return nodes.select("fp", *rest).mapInArrow(run, "probe int, sig long, fp long, " + ", ".join(f"{c} long" for c in rest))


class Near:
    """Which pairs are linked: fp within the radius and, if there are guard words, all words together
    within guard bits."""

    def __init__(self, radius: int, guard: int | None):
        self.radius, self.guard = radius, guard

    def pairs(self, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For rows i and j of words (fp first): a mask."""
        ok = np.bitwise_count(words[i, 0] ^ words[j, 0]) <= self.radius
        if self.guard is not None:
            at = np.flatnonzero(ok)
            ok[at] = np.bitwise_count(words[i[at]] ^ words[j[at]]).sum(1, dtype=np.int64) <= self.guard
        return ok

    def table(self, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For all rows i against all rows j: a mask of two dimensions."""
        ok = np.bitwise_count(words[i, 0][:, None] ^ words[j, 0][None, :]) <= self.radius
        if self.guard is not None:
            a, b = np.nonzero(ok)
            ok[a, b] = np.bitwise_count(words[i[a]] ^ words[j[b]]).sum(1, dtype=np.int64) <= self.guard
        return ok


def forest(words: np.ndarray, ids: np.ndarray, link: Near) -> tuple[list, list]:
    """Edges of a spanning forest of the links, breadth first over blocks."""
    left, us, vs = np.arange(len(ids)), [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step, front = front[:64], front[64:]
            linked = link.table(words, step, left)
            found = linked.any(0)
            if found.any():
                dist = np.bitwise_count(words[step][:, None, :] ^ words[left[found]][None, :, :]).sum(2, dtype=np.int16)
                us.append(ids[step[np.where(linked[:, found], dist, 999).argmin(0)]])  # the closest
                vs.append(ids[left[found]])
                front, left = np.concatenate([front, left[found]]), left[~found]
    return us, vs


def verify(groups: DataFrame, keys: list[str], link: Near, small: int = 48) -> DataFrame:
    """Edges (u, v) within groups of equal keys; the rows come sorted by the keys, part by part."""
    names = [*keys, "id", "fp", *(c for c in groups.columns if c in GUARDS)]
    n_keys = len(keys)

    def edges(key: np.ndarray, words: np.ndarray, ids: np.ndarray):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        of = np.repeat(sizes, sizes)
        us, vs = [], []
        for d in range(1, small):
            at = np.flatnonzero((of[:-d] <= small) & (key[d:] == key[:-d])) if len(key) > d else []
            if not len(at):
                break
            at = at[link.pairs(words, at, at + d)]
            us.append(ids[at])
            vs.append(ids[at + d])
        for start, size in zip(starts[sizes > small], sizes[sizes > small], strict=True):
            a, b = forest(words[start : start + size], ids[start : start + size], link)
            us += a
            vs += b
        return np.concatenate(us or [ids[:0]]), np.concatenate(vs or [ids[:0]])

    def made(key: np.ndarray, cols: list[np.ndarray]):
        u, v = edges(key, np.stack(cols[n_keys + 1 :], axis=1).view(np.uint64), cols[n_keys])
        if len(u):
            yield pa.record_batch({"u": pa.array(u), "v": pa.array(v)})

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch[c].to_numpy(zero_copy_only=False) for c in names]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            new = np.zeros(len(cols[0]), bool)
            new[:1] = True
            for c in cols[:n_keys]:
                new[1:] |= c[1:] != c[:-1]
            last = int(np.flatnonzero(new)[-1]) if len(new) else 0
            held = [c[last:] for c in cols]
            if last:
                yield from made(np.cumsum(new[:last]), [c[:last] for c in cols])
        if held is not None and len(held[0]):
            yield from made(np.ones(len(held[0]), int), held)

    return groups.repartition(*keys).sortWithinPartitions(*keys).select(*names).mapInArrow(run, "u long, v long")


def links(nodes: DataFrame, radius: int, guard: int | None, block: int) -> DataFrame | None:
    """Steps 3 and 4: edges (u, v) that bind the linked nodes of (id, fp, guard words); None without nodes."""
    words = [c for c in nodes.columns if c != "id"]
    n, both = bit_statistics(nodes)
    if n == 0:
        return None
    sigs = signatures(nodes, allocate(n, both, radius))
    hot = sigs.groupBy("probe", "sig").count().where(F.col("count") > block)
    hot = hot.select("probe", "sig", F.ceil(F.col("count") / block).cast("int").alias("chunks"))
    # A chunk meets itself and every other chunk of its group.
    own = F.pmod(F.xxhash64(*words), F.col("chunks")).cast("int")
    meets = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(own, j).alias("a"), F.greatest(own, j).alias("b")))
    )
    met = sigs.join(hot, ["probe", "sig"], "left").select("probe", "sig", "id", *words, F.explode(meets).alias("m")).select("probe", "sig", "m.a", "m.b", "id", *words)
    return verify(met, ["probe", "sig", "a", "b"], Near(radius, guard))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, radius: int = 3, guard: int | None = None, block: int = 2048) -> DataFrame:
    """(id, fp, component_id), a row for each input row.

    guard: beside the radius, at most so many of 256 bits may differ: those of the fingerprint and of
    three more made from the same shingles. It keeps a wide radius from linking what is not alike.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    words = ["fp", *(GUARDS if guard is not None else ())]
    fps = scratch.save(fingerprints(docs, id_col, text_col, shingle, guard is not None), "fingerprints")
    every = scratch.save(fps.groupBy(*words).agg(F.min("id").alias("id")), "nodes")
    edges = links(every.where("id is not null"), radius, guard, block)
    if edges is None:
        return fps.select("id", "fp", F.col("id").alias("component_id"))
    found = connected_components(edges, scratch)
    classes = every.join(found, every["id"] == found["node"], "left").select(*[every[w] for w in words], F.coalesce("component", "id").alias("component_id"))
    return fps.join(classes, words).select("id", "fp", "component_id")


class FirstLinks:
    """How the texts of the pipeline meet first: steps 1 to 4 for similar_classes, which has their hashes at hand."""

    def __init__(self, radius: int = 3, guard: int | None = None, block: int = 2048):
        self.radius, self.guard, self.block = radius, guard, block
        self.columns = ["fp", *(GUARDS if guard is not None else ())]

    def words(self, h: np.ndarray) -> list[int]:
        return words_of(h, self.guard is not None)

    def edges(self, rows: DataFrame, scratch: Scratch) -> DataFrame:
        """(u, v) for rows of (node, columns): the links, and ties of the nodes with equal words."""
        rows = scratch.save(rows.distinct(), "words")
        named = scratch.save(rows.groupBy(*self.columns).agg(F.min("node").alias("id")), "named")
        equal = rows.join(named, self.columns).select(F.col("id").alias("u"), F.col("node").alias("v"))
        found = links(named, self.radius, self.guard, self.block)
        both = equal if found is None else equal.union(found)
        return both.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the document of the smallest id stays.

    Fingerprints of five-word shingles link as in op3, at 3 or fewer differing bits. Their links are
    tested exactly: a Jaccard similarity of 0.8 binds, and nothing below. At 0.8 about 15 percent of the
    bits differ; so an exact join (see jaccard.py) goes on from the classes that the fingerprints gave
    and adds the pairs beyond the radius, which leaves no pair at 0.8 and more unbound. Rows are told apart by id and text, so that a
    repeated id loses only rows that have a partner; of equal rows one stays. Rows without id are
    grouped like others and stay only where no partner has an id. Null texts, empty texts and texts
    of blanks are alike and form one group. All columns are carried, whatever their names.
    """
    scratch = Scratch(spark, "dedup")
    found = scratch.save(similar_classes(docs, "doc_id", "text", size=5, least=0.8, first=FirstLinks()), "classes")
    row = F.struct("id", "text_hash")
    best = found.groupBy("component").agg(F.min(row).alias("best"), F.count("*").alias("n")).where("n > 1").select("component", "best")
    grouped = scratch.save(found.join(best, "component").select("id", "text_hash", (row == F.col("best")).alias("stays")), "grouped")
    key = [F.col("id").alias("drop_id"), F.col("text_hash").alias("drop_text")]
    dropped = scratch.save(grouped.where("not stays").select(*key).distinct(), "dropped")
    repeated = scratch.save(grouped.where("stays").groupBy(*key).count().where("count > 1").select("drop_id", "drop_text"), "repeated")
    scratch.keep_only("dropped", "repeated")
    rows = whole_rows(docs, of_id=row_id(F.col("doc_id")), of_text=F.xxhash64("text"))
    is_row = (F.col("of_id") == F.col("drop_id")) & (F.col("of_text") == F.col("drop_text"))
    kept = rows.join(near(dropped), is_row, "left_anti")
    if not repeated.isEmpty():
        again = kept.join(near(repeated), is_row, "left_semi").dropDuplicates(["of_id", "of_text"])
        kept = kept.join(near(repeated), is_row, "left_anti").unionByName(again)
    return kept.select("row.*")
