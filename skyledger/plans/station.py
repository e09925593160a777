"""The observation view as station files: a file a day with flags, clock offsets and special events,
plain or compact, put together in Python file by file, as a receiver's converter would write them.

Beside the days there is a file with a header and nothing else.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.plans.view import NAMES, SYSTEMS, observations, raw
from skyledger.sources import arrow, compact, text

EMPTY = "empty"


def flag(hour: Column) -> Column:
    return F.when(hour % 11 == 3, "1").when(hour % 13 == 5, "6").otherwise("0")


def clock(hour: Column) -> Column:
    """Clock offset, times 10^12; none every fifth hour. Nine decimals, as version 2 has no more."""
    return F.when(hour % 5 != 0, (hour % 97 - 48) * 123456000)


#: The same in SQL, over the tables r and o of the view; u holds the special events.
SQL = """, x AS (SELECT *, CASE WHEN hour % 11 = 3 THEN '1' WHEN hour % 13 = 5 THEN '6' ELSE '0' END AS flag, CASE WHEN hour % 5 <> 0 THEN (hour % 97 - 48) * 123456000 END AS clock,
  'd' || lpad(CAST(hour // 24 AS VARCHAR), 5, '0') AS day FROM o),
u AS (SELECT event_id, hour, 'd' || lpad(CAST(hour // 24 AS VARCHAR), 5, '0') AS day, CAST(2 + event_id % 4 AS VARCHAR) AS flag, 'note ' || CAST(event_id AS VARCHAR) AS note FROM r WHERE code = 'error' AND event_id % 3 = 0)
"""

ROW = ["file", "hour", "event_id", "flag", "clock", "sv", "code_idx", "value_e3", "lli", "ssi", "note"]


def special(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir).where("code = 'error' and event_id % 3 = 0")
    return rows.select("hour", "event_id", (F.col("event_id") % 4 + 2).cast("string").alias("flag"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("note"))


def station_files(spark: SparkSession, sf_dir: str, version: int, packed: bool) -> DataFrame:
    """(file, content). Compact files have differences of order 1 to 9, by the day."""
    day = F.format_string("d%05d", F.floor(F.col("hour") / 24))
    none = lambda kind: F.lit(None).cast(kind)
    o = observations(spark, sf_dir).withColumns({"file": day, "event_id": none("bigint"), "flag": flag(F.col("hour")), "clock": clock(F.col("hour")), "note": none("string")})
    e = special(spark, sf_dir).withColumns({"file": day, "clock": none("bigint"), "sv": none("string"), "code_idx": none("int"), "value_e3": none("bigint"), "lli": none("string"), "ssi": none("string")})
    last = spark.range(1).select(F.lit(EMPTY).alias("file"), *[none("bigint" if c in ("hour", "event_id", "clock", "value_e3") else "int" if c == "code_idx" else "string").alias(c) for c in ROW[1:]])

    def put(batches):
        yield from put_files(batches, version, packed)

    # sorted by the engine, so that a task holds an hour's rows and the text so far
    rows = o.select(*ROW).unionByName(e.select(*ROW)).unionByName(last).repartition("file")
    rows = rows.sortWithinPartitions("file", "hour", F.col("event_id").asc_nulls_last(), "sv", "code_idx")
    return rows.mapInArrow(put, "file string, content string")


def put_files(batches: Iterable[pa.RecordBatch], version: int, packed: bool) -> Iterator[pa.RecordBatch]:
    """Files from batches of rows in order: of a file its events before its observations in each hour."""
    for file, rows in groupby(arrow.rows_of(batches), key=lambda r: r["file"]):
        yield pa.record_batch({"file": [file], "content": [content((r for r in rows if r["hour"] is not None), version, packed)]})
        arrow.release()


def content(rows: Iterable[dict], version: int, packed: bool) -> str:
    out = bytearray()
    for line in lines_of(iter(rows), version, packed):
        out += line.encode() + b"\n"
    return out.decode()


def lines_of(rows: Iterator[dict], version: int, packed: bool) -> Iterator[str]:
    codes, first = NAMES[2 if version == 2 else 3][:5], next(rows, None)
    records = records_of(rows if first is None else chain([first], rows), version, len(codes))
    if packed:
        yield f"{'1.0' if version == 2 else '3.0':<20}{'COMPACT RINEX FORMAT':<40}CRINEX VERS   / TYPE"
        yield f"{'':<60}CRINEX PROG / DATE  "
    yield from text.header_lines(version, codes, SYSTEMS)
    if packed:
        order = 1 + (first["hour"] // 24 % 9 if first else 0)
        scaled = ((*r[:2], *(x if x is None or version != 2 else x // 1000 for x in r[2:])) for r in records)
        yield from compact.compact_lines(scaled, version, order)
        return
    for head, body, *more in records:
        yield from [head, *body] if isinstance(body, list) else plain(head, body, more[0], version)


def records_of(rows: Iterator[dict], version: int, n_codes: int) -> Iterator[tuple]:
    """Events as (line, lines), epochs as (line, fields by satellite, clock offset)."""
    for hour, part in groupby(rows, key=lambda r: r["hour"]):
        t = dt.datetime(1970, 1, 1) + dt.timedelta(hours=hour)
        sats: dict[str, list] = {}
        seen = None
        for r in part:
            if r["event_id"] is not None:
                yield (" " * 28 if version == 2 else ">" + " " * 30) + f"{r['flag']}  1", [r["note"]]
                continue
            seen = seen or r
            sats.setdefault(r["sv"], [None] * n_codes)[r["code_idx"]] = (r["value_e3"], r["lli"], r["ssi"])
        if seen:
            head = t.strftime(" %y %m %d %H %M" if version == 2 else "> %Y %m %d %H %M") + f"  0.0000000  {seen['flag']}{len(sats):3d}"
            yield head, sats, seen["clock"]


def plain(head: str, sats: dict[str, list], offset: int | None, version: int) -> list[str]:
    cell = lambda x: " " * 16 if x is None else f"{('-' if x[0] < 0 else '') + str(abs(x[0]) // 1000) + '.' + str(abs(x[0]) % 1000).zfill(3):>14}{x[1]}{x[2]}"
    decimals = 9 if version == 2 else 12
    whole, part = divmod(abs(offset or 0) // 10 ** (12 - decimals), 10**decimals)
    said = "" if offset is None else f"{'-' if offset < 0 else ''}{whole}.{part:0{decimals}d}".rjust(decimals + 3)
    names = list(sats)
    if version != 2:
        return [(head.ljust(41) + said).rstrip(), *((sv + "".join(map(cell, row))).rstrip() for sv, row in sats.items())]
    heads = [head + "".join(names[:12]), *(" " * 32 + "".join(names[i : i + 12]) for i in range(12, len(names), 12))]
    heads[0] = (heads[0].ljust(68) + said).rstrip()
    return [*heads, *("".join(map(cell, row[i : i + 5])).rstrip() for row in sats.values() for i in range(0, len(row), 5))]
