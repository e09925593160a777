"""Text files to binary stores and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.fields import render_obs
from skyledger.sources import signal_store, text
from skyledger.sources.framing import TYPES2, TYPES3


def pack(got: text.Reading, path: str, *, chunk_digest: int = 2, file_digest: int = 6) -> int:
    """Writes a store for each file read; gives the number of files."""
    lines = F.array_sort(F.collect_list(F.struct("line_no", F.rtrim("line").alias("line"))))
    heads = got.headers.groupBy("file").agg(lines.alias("l")).select("file", F.concat(F.array_join(F.col("l.line"), "\n"), F.lit("\n")).alias("text"))
    epochs = got.epochs.select("file", "epoch_idx", "date", F.col("hh_mm").cast("int").alias("hh_mm"), "sec_e7", F.col("clock_offset_e12").alias("clock"))
    events = got.events.select("file", "epoch_idx", F.concat("text", F.lit("\n")).alias("text"))
    return signal_store.write_stores(signal_store.encode_stores(got.observations, epochs, heads, events, chunk_digest=chunk_digest, file_digest=file_digest), path)


def first_line(version: Column, n: Column, clock: Column) -> Column:
    """An epoch line without satellites; columns date, hh_mm, sec_e7 and flag 0."""
    date, hm, sec = F.col("date"), F.col("hh_mm").cast("int"), F.col("sec_e7")
    parts = [F.floor(date / 10000).cast("int"), (F.floor(date / 100) % 100).cast("int"), date % 100, F.floor(hm / 100).cast("int"), hm % 100]
    seconds = F.format_string("%3d.%07d", F.floor(sec / 10_000_000).cast("int"), sec % 10_000_000)
    v2 = F.format_string(" %02d %2d %2d %2d %2d%s  0%3d", parts[0] % 100, *parts[1:], seconds, n)
    offset = F.format_string("%s%d.%012d", F.when(clock < 0, "-").otherwise(""), F.floor(F.abs(clock) / 10**12).cast("bigint"), F.abs(clock) % 10**12)
    v3 = F.format_string("> %04d %02d %02d %02d %02d%s  0%3d", *parts, seconds, n)
    return F.when(version == "2", v2).otherwise(F.when((clock != 0) & clock.isNotNull(), F.concat(F.rpad(v3, 41, " "), F.lpad(offset, 15, " "))).otherwise(v3))


def render(headers: DataFrame, epochs: DataFrame, events: DataFrame, obs: DataFrame) -> DataFrame:
    """(file, content) from headers(file, text), epochs(file, epoch_idx, date, hh_mm, sec_e7,
    clock_offset_e12), events(file, epoch_idx, text) and obs(file, epoch_idx, sv, code_idx, value_e3, lli, ssi).

    Events stand before the epoch of their number; satellites are in the order of their names. A
    version-2 line has no clock offset.
    """
    heads = headers.withColumn("version", F.substring(F.ltrim("text"), 1, 1))
    lines = F.split("text", "\n")
    label = F.when(F.col("version") == "2", TYPES2).otherwise(TYPES3)
    most = F.array_max(F.transform(F.filter(lines, lambda x: F.rtrim(F.substring(x, 61, 20)) == label), lambda x: F.coalesce(F.trim(F.when(F.col("version") == "2", F.substring(x, 1, 6)).otherwise(F.substring(x, 4, 3))).try_cast("int"), F.lit(0))))
    heads = heads.withColumn("n_codes", most).select("file", "text", "version", "n_codes")
    fields = F.map_from_entries(F.collect_list(F.struct("code_idx", render_obs(F.col("value_e3"), F.col("lli"), F.col("ssi")))))
    sats = obs.groupBy("file", "epoch_idx", "sv").agg(fields.alias("f")).join(heads.select("file", "version", "n_codes"), "file")
    dense = F.transform(F.sequence(F.lit(0), F.col("n_codes") - 1), lambda j: F.coalesce(F.element_at("f", j), F.lit(" " * 16)))
    fives = F.transform(F.sequence(F.lit(0), F.floor((F.col("n_codes") - 1) / 5).cast("int")), lambda k: F.rtrim(F.array_join(F.slice(F.col("dense"), k * 5 + 1, F.lit(5)), "")))
    sats = sats.withColumn("dense", dense).withColumn("rows", F.when(F.col("version") == "2", fives).otherwise(F.array(F.rtrim(F.concat("sv", F.array_join("dense", ""))))))
    body = sats.groupBy("file", "epoch_idx").agg(F.array_sort(F.collect_list(F.struct("sv", "rows"))).alias("s"))
    e = epochs.join(body, ["file", "epoch_idx"], "left").join(heads.select("file", "version"), "file").withColumn("s", F.coalesce("s", F.array().cast("array<struct<sv:string,rows:array<string>>>")))
    n = F.size("s")
    names = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / 12), F.lit(0)).cast("int")), lambda k: F.array_join(F.slice(F.col("s.sv"), k * 12 + 1, F.lit(12)), ""))
    head = first_line(F.col("version"), n, F.col("clock_offset_e12"))
    heads2 = F.concat(F.array(F.concat(head, names[0])), F.transform(F.slice(names, F.lit(2), F.size(names)), lambda x: F.concat(F.lit(" " * 32), x)))
    e = e.select("file", "epoch_idx", F.lit(1).alias("kind"), F.array_join(F.concat(F.when(F.col("version") == "2", heads2).otherwise(F.array(head)), F.flatten(F.col("s.rows"))), "\n").alias("part"))
    v = events.select("file", "epoch_idx", F.lit(0).alias("kind"), F.rtrim(F.col("text"), F.lit("\n")).alias("part"))
    parts = e.unionByName(v).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("epoch_idx", "kind", "part"))).alias("p"))
    return heads.join(parts, "file", "left").select("file", F.concat(F.rtrim(F.col("text"), F.lit("\n")), F.lit("\n"), F.coalesce(F.concat(F.array_join(F.col("p.part"), "\n"), F.lit("\n")), F.lit(""))).alias("content"))


def unpack(spark: SparkSession, path: str) -> DataFrame:
    """(file, content): the text of each store below a path."""
    signal_store.register(spark)
    load = lambda table: spark.read.format("signalstore").option("table", table).load(path)
    return render(load("headers"), load("epochs"), load("events"), load("observations"))
