"""Which observations a file holds, without making a row of each: what scan summaries and maxima need.

Framing is the same as for all other tables. While lines are framed, whole pieces of a file are looked
at as byte arrays: counts of certain bytes up to each position tell for any field, by two look-ups,
whether it is blank, well-formed, or other than zero. A satellite's line leaves one row for each 63
codes. Compact files leave their records, whose differences are undone as ever.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.analytics import by_word
from skyledger.scratch import Scratch
from skyledger.sources import arrow, text
from skyledger.sources.compact import decode_compact
from skyledger.sources.framing import OBS, RECORD, WORD, Framer, pieces_from

SCAN = RECORD + ", sv string, word int, n bigint, mask bigint"
SCHEMA = pa.schema([(a, {**text.TYPES, "int": pa.int32()}[b]) for a, b in (x.split() for x in SCAN.split(", "))])
HELD = 20_000  # rows put together before they are handed on


def rows_of(framer: Framer) -> Iterator[pa.RecordBatch]:
    """Records without the lines of plain observations, and the words of these."""
    held, words, n = [], [], 0
    for row in framer.rows():
        if row["kind"] == OBS and not row["compact"]:
            words.append((row["epoch_idx"], row["lines"], row.pop("shape")))
            n += len(row["lines"])
            row = row | {"lines": []}
        held.append(row)
        if n >= HELD or len(held) == 2000:
            yield from _batches(framer, held, words)
            held, words, n = [], [], 0
    yield from _batches(framer, held, words)


def _batches(framer: Framer, held: list[dict], words: list[tuple]) -> Iterator[pa.RecordBatch]:
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r.get(x.name) for r in held], x.type) for x in SCHEMA], schema=SCHEMA)
    if not words:
        return
    epoch = np.repeat([e for e, _, _ in words], [len(names) for _, names, _ in words])
    sv = np.array([x[:3] for _, names, _ in words for x in names]).astype("U3")
    filled, present = (np.concatenate([shape[k] for _, _, shape in words]) for k in (0, 1))
    for w in range(-(-filled.shape[1] // 63)):
        part = slice(63 * w, 63 * w + 63)
        some = np.flatnonzero(filled[:, part].any(axis=1))
        here = present[some, part]
        columns = {
            "file": pa.repeat(framer.file, len(some)),
            "kind": pa.repeat(WORD, len(some)),
            "epoch_idx": pa.array(epoch[some], pa.int64()),
            "sv": pc.replace_substring(pa.array(sv[some], pa.string()), " ", "0"),
            "word": pa.repeat(pa.scalar(w, pa.int32()), len(some)),
            "n": pa.array(here.sum(axis=1), pa.int64()),
            "mask": pa.array(here @ (np.int64(1) << np.arange(here.shape[1], dtype=np.int64)), pa.int64()),
        }
        yield pa.RecordBatch.from_arrays([columns[x.name] if x.name in columns else pa.nulls(len(some), x.type) for x in SCHEMA], schema=SCHEMA)


class Scan:
    """The tables of a Reading that need no values, and words(file, epoch_idx, sv, word, n, mask)."""

    def __init__(self, rows: DataFrame):
        self.recs = recs = Scratch(rows.sparkSession, "scan").save(rows, "rows")
        self.headers = text.headers(recs)
        self.obs_types = text.obs_types(self.headers)
        self.epochs, self.events, self.parse_errors = text.epochs(recs), text.events(recs), text.parse_errors(recs)
        words = recs.where(F.col("kind") == WORD).select("file", "epoch_idx", "sv", "word", "n", "mask")
        # only compact files have lines left here; a look at the first of them tells if there are any
        packed = recs.where((F.col("kind") == OBS) & F.col("compact"))
        self.words = words.unionByName(by_word(decode_compact(recs))) if packed.limit(1).count() else words


def scan_text(spark: SparkSession, *paths: str) -> Scan:
    """Scans files, folders or globs, read in pieces as by `stream_records`."""
    names = spark.read.format("binaryFile").load(list(paths)).select("path")

    def run(batches):
        for batch in batches:
            for path in batch["path"].to_pylist():
                fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
                with fs.open_input_stream(at) as stream:
                    yield from rows_of(Framer(path, pieces_from(stream), shapes=True))

    return Scan(names.mapInArrow(run, SCAN))


def scan_records(files: DataFrame) -> Scan:
    """Scans files(file, content)."""

    def run(batches):
        for file, content in arrow.files_of(batches):
            yield from rows_of(Framer(file, content or "", shapes=True))

    return Scan(files.select("file", "content").mapInArrow(run, SCAN))
