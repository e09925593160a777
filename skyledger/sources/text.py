"""Observation text files, versions 2, 3 and 4, plain and compact, as DataFrames; and their rendering.

`read_files` or any DataFrame (file, content) -> `records` -> headers, obs_types, epochs, events,
observations and parse_errors in the canonical schema.
"""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.functions.fields import full_year, obs_value, pack_date, pack_minute, packed_timestamp, parse_fixed, parse_uint, render_obs
from skyledger.scratch import Scratch, shared_dir
from skyledger.sources import arrow
from skyledger.sources.compact import decode_clock, decode_compact
from skyledger.sources.framing import EVENT, HEADER, OBS, RECORD, TYPES2, TYPES3, Framer, pieces_from

TYPES = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
FIELDS = [x.split() for x in RECORD.split(", ")]
HELD = 5000  # lines put together before they are handed on


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, content) of files, folders or globs: whole files in cells, for stores that only the
    engine's readers reach; up to 2 GB a file. `stream_records` has no such bound."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(F.col("path").alias("file"), F.col("content").cast("string").alias("content"))


def records(files: DataFrame) -> DataFrame:
    """Framed records of files(file, content)."""

    def run(batches):
        for file, content in arrow.files_of(batches):
            yield from _framed(Framer(file, content or ""))

    return files.select("file", "content").mapInArrow(run, RECORD)


def stream_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Framed records of files, folders or globs, read in pieces: a task holds a piece of a file and a
    record. The engine lists the files and deals them out; the tasks open them through pyarrow's file
    systems (local, HDFS, S3, GCS)."""
    names = spark.read.format("binaryFile").load(list(paths)).select("path")

    def run(batches):
        for batch in batches:
            for path in batch["path"].to_pylist():
                fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
                with fs.open_input_stream(at) as stream:
                    yield from _framed(Framer(path, pieces_from(stream)))

    return names.mapInArrow(run, RECORD)


def spool(spark: SparkSession, stream: io.RawIOBase | None = None, name: str = "stdin") -> str:
    """Copies standard input, or another binary stream, piece by piece to a file in the shared folder,
    and gives its path."""
    base = f"{shared_dir(spark)}/spool"
    fs, at = pafs.FileSystem.from_uri(base) if "://" in base else (pafs.LocalFileSystem(), base.removeprefix("file:"))
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/{name}") as out:
        while data := (stream or sys.stdin.buffer).read(4 << 20):
            out.write(data)
    return f"{base}/{name}"


def _framed(framer: Framer) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in framer.rows():
        held.append(row)
        n += len(row["lines"])
        if len(held) == 2000 or n >= HELD:
            yield _batch(held)
            held, n = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch({n: pa.array([r.get(n) for r in rows], TYPES[t]) for n, t in FIELDS})


def headers(recs: DataFrame) -> DataFrame:
    lines = recs.where(F.col("kind") == HEADER).select("file", "version", F.posexplode("lines").alias("line_no", "line"))
    return lines.select("file", "version", (F.col("line_no") + 1).alias("line_no"), F.rtrim(F.substring("line", 1, 60)).alias("body"), F.rtrim(F.substring("line", 61, 20)).alias("label"), "line")


def find_header(heads: DataFrame, label: str) -> DataFrame:
    """The first line of a label in each file."""
    return heads.where(F.col("label") == label).groupBy("file").agg(F.min_by("body", "line_no").alias("body"), F.min("line_no").alias("line_no"))


def obs_types(heads: DataFrame) -> DataFrame:
    """(file, version, sys, code_idx, code). Version 2 has one list, under the system ` `."""
    v3 = heads.where((F.col("version") != "2") & (F.col("label") == TYPES3))
    w = W.partitionBy("file").orderBy("line_no")
    v3 = v3.withColumn("sys", F.last(F.nullif(F.substring("line", 1, 1), F.lit(" ")), ignorenulls=True).over(w))
    v3 = v3.withColumn("n", F.last(F.nullif(parse_uint(F.substring("line", 4, 3)), F.lit(0)), ignorenulls=True).over(W.partitionBy("file", "sys").orderBy("line_no")))
    v3 = _codes(v3, 13, lambda j: F.substring("line", 8 + 4 * j, 3))
    v2 = heads.where((F.col("version") == "2") & (F.col("label") == TYPES2)).withColumn("sys", F.lit(" "))
    v2 = v2.withColumn("n", F.last(F.nullif(parse_uint(F.substring("line", 1, 6)), F.lit(0)), ignorenulls=True).over(w))
    v2 = _codes(v2, 9, lambda j: F.substring("line", 11 + 6 * j, 2))
    return v3.unionByName(v2)


def _codes(lines: DataFrame, each: int, code) -> DataFrame:
    k = F.row_number().over(W.partitionBy("file", "sys").orderBy("line_no")) - 1
    rows = lines.withColumn("k", k).select("file", "version", "sys", "n", "k", F.posexplode(F.array(*[code(j) for j in range(each)])).alias("j", "code"))
    rows = rows.withColumn("code_idx", (F.col("k") * each + F.col("j")).cast("int")).where("code_idx < n and trim(code) <> ''")
    return rows.select("file", "version", "sys", "code_idx", F.trim("code").alias("code"))


def _times(head: Column, version: Column) -> dict[str, Column]:
    at = lambda a, n: F.substring(head, a + 1, n)
    two = version == "2"
    pick = lambda x, y: F.when(two, x).otherwise(y)
    year = pick(full_year(parse_uint(at(1, 2))), parse_uint(at(2, 4)))
    return {
        "date": pack_date(year, pick(parse_uint(at(4, 2)), parse_uint(at(7, 2))), pick(parse_uint(at(7, 2)), parse_uint(at(10, 2)))),
        "hh_mm": pack_minute(pick(parse_uint(at(10, 2)), parse_uint(at(13, 2))), pick(parse_uint(at(13, 2)), parse_uint(at(16, 2)))),
        "sec_e7": parse_fixed(pick(at(15, 11), at(18, 11)), 7).cast("int"),
        "flag": pick(at(28, 1), at(31, 1)),
        "n_sats": pick(parse_uint(at(29, 3)), parse_uint(at(32, 3))),
    }


def epochs(recs: DataFrame) -> DataFrame:
    """A row for each record with observations; the clock offset of compact files is an arc of its own."""
    rows = recs.where(F.col("kind") == OBS)
    out = rows.select("file", "rec_idx", "epoch_idx", *[c.alias(n) for n, c in _times(F.col("head"), F.col("version")).items()], "compact", "version", "clock", "init")
    out = out.withColumn("ts", packed_timestamp(F.col("date"), F.col("hh_mm"), F.col("sec_e7")))
    plain = out.where("not compact").withColumn("clock_offset_e12", parse_fixed(F.col("clock"), 12))
    return plain.unionByName(decode_clock(out.where("compact"))).drop("version")


def events(recs: DataFrame) -> DataFrame:
    """Special events with their whole text, the first line included."""
    rows = recs.where(F.col("kind") == EVENT)
    flag = F.when(F.col("version") == "2", F.substring("head", 29, 1)).otherwise(F.substring("head", 32, 1))
    return rows.select("file", "rec_idx", "epoch_idx", flag.alias("flag"), (F.size("lines") - 1).alias("n_lines"), F.array_join("lines", "\n").alias("text"))


def observations(recs: DataFrame) -> DataFrame:
    """A row for each observation that is there. Framing has left out records with a bad field, and a
    record carries its file's code names; so nothing is joined, shuffled or looked at twice."""
    rows = recs.where((F.col("kind") == OBS) & ~F.col("compact")).select("file", "version", "epoch_idx", "codes", F.posexplode("lines").alias("sv_pos", "line"))
    n = F.ceil((F.length(F.rtrim("line")) - 3) / 16).cast("int")
    sys, prn = F.substring("line", 1, 1), parse_uint(F.substring("line", 2, 2))
    names = F.split(F.element_at(F.str_to_map("codes", F.lit(";"), F.lit(":")), F.when(F.col("version") == "2", " ").otherwise(sys)), ",")
    rows = rows.where(n > 0).select("file", "epoch_idx", "sv_pos", "line", sys.alias("sys"), prn.alias("prn"), names.alias("names"), n.alias("n"))
    rows = rows.withColumn("sv", F.concat("sys", F.lpad(F.col("prn").cast("string"), 2, "0")))
    rows = rows.select("file", "epoch_idx", "sv_pos", "line", "sys", "prn", "sv", F.posexplode(F.slice("names", F.lit(1), F.col("n"))).alias("code_idx", "code"))
    # one field at a time from here, in compiled code
    field = F.rpad(F.substring(F.col("line"), 4 + 16 * F.col("code_idx"), F.lit(16)), 16, " ")
    rows = rows.select("file", "epoch_idx", "sv_pos", "sys", "prn", "sv", "code_idx", "code", field.alias("field")).where((F.col("field") != " " * 16) & (F.col("code") != ""))
    order = ["file", "epoch_idx", "sv_pos", "sys", "prn", "sv", "code_idx", "code", "value_e3", "lli", "ssi"]
    plain = rows.select(*order[:8], obs_value(F.col("field")).alias("value_e3"), F.substring("field", 15, 1).alias("lli"), F.substring("field", 16, 1).alias("ssi"))
    return plain.unionByName(decode_compact(recs).select(*order))


def parse_errors(recs: DataFrame) -> DataFrame:
    return recs.where("error is not null").select("file", "rec_idx", "line_no", "error", "reason")


class Reading:
    """All tables of a set of files. Framing is the one step in Python: recs are written once, and all
    tables read what was written (written=False: they are framed anew for each table)."""

    def __init__(self, recs: DataFrame, written: bool = True):
        self.recs = recs = Scratch(recs.sparkSession, "records").save(recs, "records") if written else recs
        self.headers = headers(recs)
        self.obs_types = obs_types(self.headers)
        self.epochs, self.events, self.parse_errors = epochs(recs), events(recs), parse_errors(recs)
        self.observations = observations(recs)


def read_text(spark: SparkSession, *paths: str, mode: str = "PERMISSIVE", whole_files: bool = False) -> Reading:
    """mode FAILFAST raises at the first bad record; PERMISSIVE leaves it in parse_errors. whole_files
    reads files as cells, from any store that the engine reads."""
    out = Reading(records(read_files(spark, *paths)) if whole_files else stream_records(spark, *paths))
    if mode.upper() == "FAILFAST":
        worst = out.parse_errors.limit(1).collect()
        if worst:
            raise ValueError(f"{worst[0]['file']}, line {worst[0]['line_no']}: {worst[0]['reason']}")
    return out


# Rendering -----------------------------------------------------------------------------------------


def header_lines(version: int, codes: tuple[str, ...], systems: str) -> list[str]:
    line = lambda body, name: f"{body:<60.60}{name:<20}"
    out = [line(f"{version:6d}.{'11' if version == 2 else '04'}           OBSERVATION DATA    M (MIXED)", "RINEX VERSION / TYPE")]
    if version == 2:
        for k in range(0, len(codes), 9):
            out.append(line((f"{len(codes):6d}" if k == 0 else " " * 6) + "".join(f"    {c}" for c in codes[k : k + 9]), TYPES2))
    else:
        for s in systems:
            for k in range(0, len(codes), 13):
                out.append(line((f"{s}  {len(codes):3d}" if k == 0 else " " * 6) + "".join(f" {c}" for c in codes[k : k + 13]), TYPES3))
    return [*out, line("", "END OF HEADER")]


def render_body(obs: DataFrame, n_codes: int, version: int) -> DataFrame:
    """(file, t, lines): the lines of each epoch of obs(file, t timestamp, sv, code_idx, value_e3, lli, ssi)."""
    fields = F.map_from_entries(F.collect_list(F.struct("code_idx", render_obs(F.col("value_e3"), F.col("lli"), F.col("ssi")))))
    sats = obs.groupBy("file", "t", "sv").agg(fields.alias("f"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(n_codes - 1)), lambda j: F.coalesce(F.element_at("f", j), F.lit(" " * 16)))
    sats = sats.withColumn("dense", dense)
    if version == 2:
        rows = [F.rtrim(F.array_join(F.slice("dense", 5 * k + 1, 5), "")) for k in range(-(-n_codes // 5))]
        sats = sats.withColumn("rows", F.array(*rows))
    else:
        sats = sats.withColumn("rows", F.array(F.rtrim(F.concat("sv", F.array_join("dense", "")))))
    e = sats.groupBy("file", "t").agg(F.array_sort(F.collect_list(F.struct("sv", "rows"))).alias("s"))
    n, body = F.size("s"), F.flatten(F.col("s.rows"))
    if version == 2:
        names = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 12).cast("int")), lambda k: F.array_join(F.slice(F.col("s.sv"), k * 12 + 1, F.lit(12)), ""))
        head = F.concat(F.date_format("t", " yy MM dd HH mm ss.SSSSSS0"), F.lit("  0"), F.lpad(n.cast("string"), 3, " "))
        # single-digit seconds are padded like F11.7
        lines = F.concat(F.array(F.concat(head, names[0])), F.transform(F.slice(names, F.lit(2), F.size(names)), lambda x: F.concat(F.lit(" " * 32), x)), body)
    else:
        head = F.concat(F.date_format("t", "'>' yyyy MM dd HH mm ss.SSSSSS0"), F.lit("  0"), F.lpad(n.cast("string"), 3, " "))
        lines = F.concat(F.array(head), body)
    return e.select("file", "t", lines.alias("lines"))


def render_files(obs: DataFrame, codes: tuple[str, ...], systems: str, version: int) -> DataFrame:
    """(file, content): whole files, each of which one task puts together."""
    top = "\n".join(header_lines(version, codes, systems))
    body = render_body(obs, len(codes), version).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("t", "lines"))).alias("e"))
    return body.select("file", F.concat(F.lit(top + "\n"), F.array_join(F.flatten(F.col("e.lines")), "\n"), F.lit("\n")).alias("content"))


def write_text(files: DataFrame, path: str) -> None:
    """Files(file, content) as text, a folder for each file name."""
    files.withColumn("value", F.rtrim(F.col("content"), F.lit("\n"))).select("file", "value").write.mode("overwrite").partitionBy("file").text(path)
