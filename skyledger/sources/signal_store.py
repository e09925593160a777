"""The binary per-signal layout as a data source, and its writer.

`spark.read.format("signalstore").load(path)` gives observations; satellite and code filters are
pushed to the chunks: files are read in ranges, by the directory's offsets, and what is not asked for is
not read; `register` switches this on, and with option pushdown=false it is not needed.
Options: table (observations, epochs, events, headers, satellites), columns of indicators are decoded
only with indicators=true (the default).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from skyledger.sources import arrow
from skyledger.sources.codec import Contents, Ranged, Store, encode_file

SCHEMAS = {
    "observations": "file string, epoch_idx bigint, sys string, prn int, sv string, code_idx int, code string, value_e3 bigint, lli string, ssi string",
    "epochs": "file string, epoch_idx bigint, date int, hh_mm int, sec_e7 int, clock_offset_e12 bigint",
    "events": "file string, epoch_idx bigint, text string",
    "headers": "file string, text string",
    "satellites": "file string, sv string, n_epochs bigint, codes array<string>",
}
HEAD, EVENT, SIGNAL = 0, 1, 2  # rows of a file, in this order


class StoreSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "signalstore"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "observations")]

    def reader(self, schema) -> DataSourceReader:
        return StoreReader(dict(self.options)) if self.options.get("pushdown", "true") == "false" else PushingReader(dict(self.options))


class OneFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class StoreReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.wanted = options, {}

    def partitions(self):
        fs, base = pafs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (pafs.LocalFileSystem(), self.options["path"].removeprefix("file:"))
        info = fs.get_file_info(base)
        found = [info] if info.is_file else [x for x in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if x.is_file and not x.base_name.startswith(("_", "."))]
        return [OneFile(x.path) for x in found]

    def read(self, part: OneFile) -> Iterator[tuple]:
        fs = pafs.FileSystem.from_uri(self.options["path"])[0] if "://" in self.options["path"] else pafs.LocalFileSystem()
        with fs.open_input_file(part.path) as f:
            yield from self.rows(part.path.rsplit("/", 1)[-1], Store(Ranged(f, f.size())))

    def rows(self, file: str, store: Store) -> Iterator[tuple]:
        table = self.options.get("table", "observations")
        if table == "headers":
            yield (file, store.header)
        elif table == "epochs":
            yield from ((file, k, *e) for k, e in enumerate(store.epochs()))
        elif table == "events":
            yield from ((file, k, text) for k, text in store.events())
        elif table == "satellites":
            for sv, at in store.satellites().items():
                numbers, signals = store.satellite(at)
                yield (file, sv, len(numbers), list(signals))
        else:
            yield from self.observations(file, store)

    def observations(self, file: str, store: Store) -> Iterator[tuple]:
        want, indicators = self.wanted, self.options.get("indicators", "true").lower() == "true"
        for sv, at in store.satellites().items():
            if sv not in want.get("sv", {sv}) or sv[0] not in want.get("sys", {sv[0]}):
                continue
            numbers, signals = store.satellite(at)
            order = store.codes.get(sv[0], store.codes.get(" ", []))
            for code, place in signals.items():
                if code not in want.get("code", {code}):
                    continue
                values, lli, ssi = store.signal(place)
                idx = order.index(code)
                for k, v, a, b in zip(numbers, values.tolist(), lli, ssi, strict=True):
                    if v or a != " " or b != " ":  # a zero with blanks is a missing value
                        yield (file, k, sv[0], int(sv[1:]), sv, idx, code, v, a if indicators else None, b if indicators else None)


class PushingReader(StoreReader):
    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) else None
            if self.options.get("table", "observations") == "observations" and name in ("sv", "code", "sys"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f


def register(spark: SparkSession) -> None:
    """Makes the source known, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreSource)


def encode_stores(obs: DataFrame, epochs: DataFrame, headers: DataFrame, events: DataFrame | None = None, *, chunk_digest: int = 0, file_digest: int = 0) -> DataFrame:
    """(file, content): a binary file for each file of obs(file, epoch_idx, sv, code, value_e3, lli, ssi),
    epochs(file, epoch_idx, date, hh_mm, sec_e7, clock) and headers(file, text). A file is one task's, which
    holds its epochs, a satellite and what is encoded so far."""
    e = epochs.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("epoch_idx", "date", "hh_mm", "sec_e7", "clock"))).alias("epochs"))
    rows = headers.join(e, "file").select("file", F.lit(HEAD).alias("kind"), "text", "epochs")
    if events is not None:
        rows = rows.unionByName(events.select("file", F.lit(EVENT).alias("kind"), "text", "epoch_idx"), allowMissingColumns=True)
    signals = obs.groupBy("file", "sv", "code").agg(F.array_sort(F.collect_list(F.struct("epoch_idx", "value_e3", "lli", "ssi"))).alias("v"))
    rows = rows.unionByName(signals.select("file", F.lit(SIGNAL).alias("kind"), "sv", "code", "v"), allowMissingColumns=True)
    rows = rows.select("file", "kind", "text", "epochs", *(["epoch_idx"] if events is not None else [F.lit(None).cast("bigint").alias("epoch_idx")]), "sv", "code", "v")

    def run(batches):
        yield from encoded(batches, chunk_digest, file_digest)

    return rows.repartition("file").sortWithinPartitions("file", "kind", "epoch_idx", "text", "sv", "code").mapInArrow(run, "file string, content binary")


def _columns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """file, kind, text, epochs, epoch_idx, sv, code and v of each row; of epochs and v their columns."""
    for batch in batches:
        columns = [batch[c] for c in ("file", "kind", "text", "epochs", "epoch_idx", "sv", "code", "v")]
        for k in range(batch.num_rows):
            yield tuple(x[k].values if isinstance(x, pa.ListArray) else x[k].as_py() for x in columns)


def encoded(batches: Iterable[pa.RecordBatch], chunk_digest: int, file_digest: int) -> Iterator[pa.RecordBatch]:
    """Stores from batches of rows in order: of a file its header with the epochs, events, then signals."""
    for file, rows in groupby(_columns(batches), key=lambda r: r[0]):
        _, kind, text, times, *_ = next(rows)
        if kind != HEAD:  # without header or epochs there is no store
            continue
        index, date, hh_mm, sec_e7, clock = (times.field(c).to_pylist() for c in ("epoch_idx", "date", "hh_mm", "sec_e7", "clock"))
        place = {k: at for at, k in enumerate(index)}
        rest = _Rest(rows)
        c = Contents(text, list(zip(date, hh_mm, sec_e7, [x or 0 for x in clock], strict=True)), rest.events(), rest.satellites(place))
        yield pa.record_batch({"file": [file], "content": pa.array([encode_file(c, chunk_digest, file_digest)], pa.binary())})
        arrow.release()


class _Rest:
    """A file's events, then its satellites, as they are asked for."""

    def __init__(self, rows: Iterator[tuple]):
        self.rows, self.held = rows, None

    def events(self) -> Iterator[tuple[int, str]]:
        for r in self.rows:
            if r[1] != EVENT:
                self.held = r
                return
            yield r[4], r[2]

    def satellites(self, place: dict[int, int]) -> Iterator[tuple]:
        for sv, part in groupby(self.rows if self.held is None else chain([self.held], self.rows), key=lambda r: r[5]):
            signals = {}
            for *_, code, v in part:
                index, values, lli, ssi = (v.field(c).to_pylist() for c in ("epoch_idx", "value_e3", "lli", "ssi"))
                signals[code] = ([place[k] for k in index], values, [x or " " for x in lli], [x or " " for x in ssi])
            yield sv, (sorted({k for x in signals.values() for k in x[0]}), signals)


def store_name(name: str) -> str:
    """`x.rnx` and `x.NNo` become `x.srnx`; other names get the ending."""
    import re

    found = re.match(r"(?i)(.*)\.(?:rnx|[0-9][0-9]o)$", name)
    return f"{found[1] if found and len(name) >= 12 else name}.srnx"


def write_stores(files: DataFrame, path: str) -> int:
    """Writes files(file, content) below a path that pyarrow.fs reaches; gives the number of files.
    Each goes to a name of its own first and is then moved, so a lost task leaves no half file."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for file, content in arrow.files_of([batch]):
                name = store_name(file.rsplit("/", 1)[-1])
                with fs.open_output_stream(f"{base}/.{name}.part") as f:
                    f.write(content)
                fs.move(f"{base}/.{name}.part", f"{base}/{name}")
            yield pa.record_batch({"n": [batch.num_rows]})

    return files.select("file", "content").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
