"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds all normalised test items. Training words stream through it while the longest
suffix that occurs in some item is tracked; from that length follow the occurrences of item windows
(eight consecutive words, or a whole shorter item), the words hit, the items and the spans. Spans of
at least the length limit can be cut from the text, and documents beyond the coverage limit removed.

The automaton grows with the benchmark, not with the corpus. A benchmark of more than max_words
words is dealt into several automata, so that the driver and the tasks hold one at a time. Only texts
that hold the hash of some window are then streamed through them; the corpus is read twice, however
many there are, and never written anew.

Cases: null and empty texts have no words and are never hit; null or empty items give no window;
items with equal id count once; items with null id are matched and cut, but not listed or counted;
repeated documents are treated alike; columns beside those named are carried or left, never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import Scratch, map_rows, text_bytes, whole_rows, with_columns

WINDOW = 8
#: Lower-cases A-Z; every other ASCII character than letters and digits becomes a blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class SuffixAutomaton:
    """Of several word sequences; state 0 is the empty word sequence."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set] = [set()]  # items with a prefix that ends in the state
        ends: list[tuple[int, int, str | None]] = []  # whole items shorter than a window: state, words, id
        for item, sequence in items:
            last = 0
            for w in sequence:
                last = self._extend(last, w, own)
                own[last].add(item)
            if 0 < len(sequence) < window:
                ends.append((last, len(sequence), item))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for v in reversed(order):  # an item that ends in a state also ends in what the state links to
            if self.link[v] > 0:
                own[self.link[v]] |= own[v]
        #: What the last `window` words of a match name: items; set where a state covers that length.
        self.items: list[frozenset | None] = [None] * len(self.length)
        #: Whole short items that end here: longest, and all their ids with their lengths.
        self.short: list[tuple[int, tuple]] = [(0, ())] * len(self.length)
        at_end: dict[int, list] = {}
        for v, n, item in ends:
            at_end.setdefault(v, []).append((n, item))
        for v in order:
            parent = self.link[v]
            if self.length[v] >= window:
                self.items[v] = frozenset(own[v]) if self.length[parent] < window else self.items[parent]
            mine = tuple(sorted(set(at_end.get(v, ())), key=lambda x: (x[0], str(x[1]))))
            above = self.short[parent]
            self.short[v] = (max([above[0], *(n for n, _ in mine)]), above[1] + mine)

    def _extend(self, last: int, w: bytes, own: list[set]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, q, w, own)
        cur = len(length)
        nxt.append({}), link.append(0), length.append(length[last] + 1), own.append(set())
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w, own)
        return cur

    def _clone(self, p: int, q: int, w: bytes, own: list[set]) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(length)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1), own.append(set())
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        link[q] = new
        return new

    def scan(self, sequence: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of hit words, as (start, end) word numbers, and the items that occur."""
        nxt, link, length, short, named, window = self.next, self.link, self.length, self.short, self.items, self.window
        spans: list[list[int]] = []
        seen: set = set()
        last_named, last_short = None, ()
        v = n = 0
        for i, w in enumerate(sequence):
            to = nxt[v].get(w)
            if to is None:
                if v == 0:
                    continue
                while True:
                    v = link[v]
                    if v < 0:
                        v = n = 0
                        break
                    to = nxt[v].get(w)
                    if to is not None:
                        n = length[v] + 1
                        v = to
                        break
                if v == 0:
                    continue
            else:
                v = to
                n += 1
            hit = 0
            if n >= window:
                hit = n
                if named[v] is not last_named:
                    last_named = named[v]
                    seen |= last_named
            if short[v][0]:
                for m, item in short[v][1]:
                    if m <= n:
                        hit = max(hit, m)
                        seen.add(item)
            if hit:
                start = i + 1 - hit
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])
        return [(a, b) for a, b in spans], seen


class Items:
    """The benchmark's items as batches of (id, words), of about max_words words each.

    Items stream to the driver one by one, as often as the batches are asked for; one batch is held at a
    time. An item of more words comes in pieces that overlap by a window less one word, so that each of
    its windows stands in a piece.
    """

    def __init__(self, items: DataFrame, id_col: str = "item_id", text_col: str = "text", *, window: int = WINDOW, max_words: int = 100_000):
        self.rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
        self.window, self.max_words = window, max(max_words, window)

    def __iter__(self) -> Iterator[list[tuple[str | None, list[bytes]]]]:
        batch, n = [], 0
        for r in self.rows.toLocalIterator():
            sequence = words(bytes(r["text"]) if r["text"] is not None else None)
            step = self.max_words - self.window + 1
            pieces = [sequence[i : i + self.max_words] for i in range(0, len(sequence) - self.window + 1, step)] if len(sequence) > self.max_words else [sequence]
            for piece in pieces:
                batch.append((r["item"], piece))
                n += len(piece)
                if n >= self.max_words:
                    yield batch
                    batch, n = [], 0
        if batch:
            yield batch


class WindowFilter:
    """A bit map of the hashes of all item windows. No text that holds a window passes it unnoticed; of
    others about one window in 16 for each length does."""

    def __init__(self, batches: Iterable[list[tuple[str | None, list[bytes]]]], window: int):
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for _, sequence in batch:
                n = min(len(sequence), window)
                if n:
                    found.setdefault(n, []).append(np.unique(self.hashes(self.word_hashes(sequence), n)))
        self.maps: dict[int, np.ndarray] = {}
        for n, parts in found.items():
            bits = 1 << max(10, int(16 * sum(map(len, parts))).bit_length())
            mask = np.zeros(bits >> 3, np.uint8)
            for part in parts:
                at = part & np.uint64(bits - 1)
                np.bitwise_or.at(mask, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            self.maps[n] = mask

    @staticmethod
    def word_hashes(sequence: list[bytes]) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh64_intdigest, sequence), np.uint64, len(sequence))

    @staticmethod
    def hashes(h: np.ndarray, n: int) -> np.ndarray:
        if len(h) < n:
            return h[:0]
        out = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j]
        return out ^ (out >> np.uint64(31))

    def may_hold(self, sequence: list[bytes]) -> bool:
        h = self.word_hashes(sequence)
        for n, mask in self.maps.items():
            at = self.hashes(h, n) & np.uint64(len(mask) * 8 - 1)
            if (mask[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).any():
                return True
        return False


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans become one; spans that only touch stay two."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


ADDED = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>, kept_text string, removed boolean"
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Rows of hit texts that are broadcast at most; beyond, they are joined by key.
MOST_HIT = 50_000


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    out, at, spans = [], 0, iter(spans)
    start, end = next(spans)
    for i, m in enumerate(WORD.finditer(text)):
        if i == start:
            out.append(text[at : m.start()])
        if i == end - 1:
            at = m.end()
            start, end = next(spans, (-1, -1))
    return b"".join([*out, text[at:]])


def scan_documents(docs: DataFrame, items: Items, text_col: str = "text", keep: dict[str, str] | None = None, *, min_span: int = 0, max_coverage: float | None = None) -> DataFrame:
    """The columns of keep (input column -> name), and those of `scanned`."""
    rows = docs.select(*[F.col(c).alias(name) for c, name in (keep or {}).items()], F.col(text_col).alias("_text"))
    return scanned(rows, items, min_span=min_span, max_coverage=max_coverage)


def scanned(rows: DataFrame, items: Items, *, min_span: int = 0, max_coverage: float | None = None) -> DataFrame:
    """rows with n_words, n_hit, items (ids as sorted strings), spans (word numbers), kept_text and
    removed in place of `_text`.

    kept_text is the text without the spans of min_span words or more (0: nothing is cut). removed
    tells that more than max_coverage of the words were hit (None: never). A benchmark of one batch
    takes one pass. Of more, one pass over the documents writes the different texts that the window
    filter can't rule out; each batch's automaton streams over these alone; and what was found is
    joined to the documents by two hashes of the text.
    """
    batches = iter(items)
    first = next(batches, [])
    if next(batches, None) is None:
        return assembled(rows, SuffixAutomaton(first, items.window), min_span, max_coverage)
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "decontaminate")
    key = [F.xxhash64("_text").alias("h1"), F.xxhash64(F.lit("x"), "_text").alias("h2")]
    shared = spark.sparkContext.broadcast(WindowFilter(items, items.window))

    def make_filter():
        may_hold = shared.value.may_hold

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([may_hold(words(t)) for t in text_bytes(batch["_text"])], pa.bool_()))

        return f

    texts = map_rows(rows.select("_text", *key), make_filter, "_text string, h1 long, h2 long")
    texts = scratch.save(texts.dropDuplicates(["h1", "h2"]), "texts")
    found = None
    for k, batch in enumerate(items):
        hit = assembled(texts, SuffixAutomaton(batch, items.window), 0, None).where("n_hit > 0").select("h1", "h2", "items", "spans")
        hit = scratch.save(hit, f"hit-{k}")
        found = hit if found is None else found.union(hit)
    # a text has a row for each batch that hits it
    found = found.groupBy("h1", "h2").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("_items"), F.flatten(F.collect_list("spans")).alias("_spans"))
    found = scratch.save(found, "found")
    scratch.keep_only("found")
    carried = [c for c in rows.columns if c != "_text"]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), "_text", *key) if carried else rows.select(F.lit(None).cast("string").alias("row"), "_text", *key)
    joined = packed.join(F.broadcast(found) if found.count() <= MOST_HIT else found, ["h1", "h2"], "left").select("row", "_text", "_items", "_spans")
    out = assembled(joined, None, min_span, max_coverage)
    return out.select(*(["row.*"] if carried else []), *[c for c in out.columns if c != "row"])


def assembled(rows: DataFrame, machine: SuffixAutomaton | None, min_span: int, max_coverage: float | None) -> DataFrame:
    """The result's columns from the automaton or, without one, from columns _items and _spans."""
    shared = None if machine is None else rows.sparkSession.sparkContext.broadcast(machine)
    carried = [c for c in rows.columns if c not in ("_text", "_items", "_spans")]
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def make():
        scan = None if shared is None else shared.value.scan

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, n_hit, items, spans, texts, removed = [], [], [], [], [], []
            texts_in = text_bytes(batch["_text"])
            known = ((None, None) for _ in texts_in) if scan else zip(batch["_items"].to_pylist(), batch["_spans"].to_pylist(), strict=True)
            for text, (seen, old) in zip(texts_in, known, strict=True):
                sequence = words(text)
                if scan:
                    found, seen = scan(sequence)
                else:
                    found = merged([(x["start"], x["end"]) for x in old or ()])
                items.append(sorted({x for x in seen or () if x is not None}))
                hit = sum(b - a for a, b in found)
                n_words.append(len(sequence))
                n_hit.append(hit)
                spans.append([{"start": a, "end": b} for a, b in found])
                long = [x for x in found if min_span and x[1] - x[0] >= min_span]
                texts.append(cut(text, long) if long else text)
                removed.append(max_coverage is not None and hit > max_coverage * len(sequence))
            return pa.record_batch({c: batch[c] for c in carried} | {
                "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "items": pa.array(items, pa.list_(pa.string())),
                "spans": pa.array(spans, span_type), "kept_text": pa.array(texts, pa.binary()).cast(pa.string()), "removed": pa.array(removed, pa.bool_()),
            })

        return f

    schema = with_columns(rows.select(*carried, "_text"), ADDED, without="_text")
    return map_rows(rows, make, schema)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_documents(docs, Items(spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "text", {"doc_id": "doc_id"})
    n_items = F.size("items")
    return found.select(
        "doc_id", "n_words", "n_hit", n_items.cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 8) AS n, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS g
      FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM g),
p AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n)),
m AS (SELECT p.r, p.i, p.n, g.item FROM p JOIN g USING (n, g)),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM m) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: cuts every span of a window or more out of the texts, and removes documents
    of which more than half was hit or in which two test items or more occur.

    Null and empty texts, rows without id and repeated rows stay unless they are hit. n_chars follows
    a cut text, where there is such a column. All columns are carried, whatever their names.
    """
    found = scanned(whole_rows(docs, _text=F.col("text")), Items(spark.read.parquet(f"{sf_dir}/benchmark.parquet")), min_span=1, max_coverage=0.5)
    kept = found.where(~F.col("removed") & (F.size("items") < 2))
    row = F.col("row").withField("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    return kept.select(F.when(F.col("n_hit") > 0, row).otherwise(F.col("row")).alias("row")).select("row.*")
