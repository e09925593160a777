"""Queries over station files: compact text, flags, events, clocks, stores, streams and commands."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger import cli
from skyledger.functions import fields as fn
from skyledger.operators import analytics as an
from skyledger.plans import station, view
from skyledger.plans.registry import IDENTITY, query
from skyledger.plans.view import CODES, NAMES, SYSTEMS, observations, raw
from skyledger.scratch import Scratch
from skyledger.sources import compact, convert, signal_store, text
from skyledger.sources import scan as scanning
from skyledger.streaming import passes as st

ST = station.SQL


def reading(spark: SparkSession, sf_dir: str, version: int, packed: bool = False) -> text.Reading:
    return text.Reading(text.records(station.station_files(spark, sf_dir, version, packed)))


def back(spark: SparkSession, sf_dir: str, obs: DataFrame, epochs: DataFrame) -> DataFrame:
    """Observations of station files under the view's codes and epochs."""
    first = raw(spark, sf_dir).agg(F.min("hour")).first()[0] or 0
    hours = epochs.select("file", "epoch_idx", (view.hour(F.col("ts")) - first).alias("hour_idx"))
    code = F.element_at(F.array(*map(F.lit, CODES)), F.col("code_idx") + 1)
    return obs.join(hours, ["file", "epoch_idx"]).select(F.lit(view.FILE).alias("file"), F.col("hour_idx").alias("epoch_idx"), "sys", "prn", "sv", "code_idx", code.alias("code"), "value_e3", "lli", "ssi")


def whole(spark: SparkSession, sf_dir: str, got: text.Reading) -> DataFrame:
    return back(spark, sf_dir, got.observations, got.epochs)


@query(IDENTITY)
def obs_compact_v2_roundtrip(spark, sf_dir):
    """Compact text of orders 1 to 9, with satellites that come and go, flags, clocks and events."""
    return whole(spark, sf_dir, reading(spark, sf_dir, 2, True))


@query(IDENTITY)
def obs_compact_v3_roundtrip(spark, sf_dir):
    return whole(spark, sf_dir, reading(spark, sf_dir, 3, True))


@query(IDENTITY)
def obs_station_v2_roundtrip(spark, sf_dir):
    return whole(spark, sf_dir, reading(spark, sf_dir, 2))


@query(IDENTITY)
def obs_station_v4_roundtrip(spark, sf_dir):
    return whole(spark, sf_dir, reading(spark, sf_dir, 4))


EPOCHS = ST + "SELECT day AS file, hour, flag, CAST(count(DISTINCT sv) AS INTEGER) AS n_sats, coalesce(CAST(clock AS VARCHAR), '') AS clock_offset_e12 FROM x GROUP BY day, hour, flag, clock"


def epoch_rows(got: text.Reading) -> DataFrame:
    return got.epochs.select("file", view.hour(F.col("ts")).alias("hour"), "flag", "n_sats", F.coalesce(F.col("clock_offset_e12").cast("string"), F.lit("")).alias("clock_offset_e12"))


@query(EPOCHS)
def obs_compact_v2_epochs(spark, sf_dir):
    """Epoch lines put together again from their changes, and clock offsets from an arc of their own."""
    return epoch_rows(reading(spark, sf_dir, 2, True))


@query(EPOCHS)
def obs_compact_v3_epochs(spark, sf_dir):
    return epoch_rows(reading(spark, sf_dir, 3, True))


@query(EPOCHS)
def obs_station_epochs(spark, sf_dir):
    return epoch_rows(reading(spark, sf_dir, 3))


@query(EPOCHS)
def obs_station_v2_epochs(spark, sf_dir):
    return epoch_rows(reading(spark, sf_dir, 2))


EVENTS = ST + """, k AS (SELECT day, hour, row_number() OVER (PARTITION BY day ORDER BY hour) - 1 AS epoch_idx FROM (SELECT DISTINCT day, hour FROM o1) )
SELECT u.day AS file, u.flag, u.note, (SELECT count(*) FROM k WHERE k.day = u.day AND k.hour < u.hour) AS epoch_idx, 1 AS n_lines FROM u""".replace("o1", "x")


def event_rows(got: text.Reading) -> DataFrame:
    return got.events.select("file", "flag", F.split("text", "\n")[1].alias("note"), "epoch_idx", "n_lines")


@query(EVENTS)
def obs_station_events(spark, sf_dir):
    """Special events with their text, and the number of the epoch before which they stand."""
    return event_rows(reading(spark, sf_dir, 3))


@query(EVENTS)
def obs_compact_events(spark, sf_dir):
    return event_rows(reading(spark, sf_dir, 2, True))


@query(ST + "SELECT day AS file, flag, count(DISTINCT hour) AS epochs, count(*) AS n FROM x WHERE flag IN ('0', '1') GROUP BY ALL")
def obs_usual_epochs(spark, sf_dir):
    """Observations of epochs of flags 0 and 1 only."""
    got = reading(spark, sf_dir, 3)
    usual = got.epochs.where(F.col("flag").isin("0", "1")).select("file", "epoch_idx", "flag")
    return got.observations.join(usual, ["file", "epoch_idx"]).groupBy("file", "flag").agg(F.countDistinct("epoch_idx").alias("epochs"), F.count("*").alias("n"))


SCAN = ST + """, usual AS (SELECT * FROM x WHERE flag IN ('0', '1')), rec AS (SELECT day, count(*) AS epochs FROM (SELECT DISTINCT day, hour, -1 AS event_id FROM x UNION ALL SELECT day, hour, event_id FROM u) GROUP BY day),
eh AS (SELECT day, hour, count(DISTINCT sv) AS sats, count(*) FILTER (WHERE value_e3 <> 0) AS n FROM usual GROUP BY day, hour),
a AS (SELECT day, max(n) AS maxobs, max(sats) AS maxsats, CAST(sum(n) AS BIGINT) AS totobs FROM eh GROUP BY day),
b AS (SELECT day, count(DISTINCT (sv, code)) FILTER (WHERE value_e3 <> 0) AS satobs FROM usual GROUP BY day),
c AS (SELECT day, max(n) AS maxepochs FROM (SELECT day, sv, count(DISTINCT hour) AS n FROM usual GROUP BY day, sv) GROUP BY day)
SELECT day AS filename, epochs, coalesce(maxobs, 0) AS maxobs, coalesce(maxsats, 0) AS maxsats, CAST(0 AS BIGINT) AS sysobs, coalesce(satobs, 0) AS satobs, coalesce(totobs, 0) AS totobs, coalesce(maxepochs, 0) AS maxepochs
FROM rec LEFT JOIN a USING (day) LEFT JOIN b USING (day) LEFT JOIN c USING (day) UNION ALL SELECT 'empty', 0, 0, 0, 0, 0, 0, 0"""


@query(SCAN)
def obs_scan_csv(spark, sf_dir):
    """The scan command's lines as CSV files, read again: flags 0 and 1, all records counted, and a line
    for a file without observations."""
    out = Scratch(spark, "scan").path("csv")
    cli.scan(scanning.scan_records(station.station_files(spark, sf_dir, 3, False)), False)[-1].write.option("header", True).csv(out)
    return spark.read.option("header", True).schema("filename string, epochs bigint, maxobs bigint, maxsats bigint, sysobs bigint, satobs bigint, totobs bigint, maxepochs bigint").csv(out)


@query(ST + """, p AS (SELECT day, hour, sys, count(DISTINCT sv) AS n FROM x WHERE flag IN ('0', '1') GROUP BY ALL),
t AS (SELECT day, hour, CAST(sum(n) AS BIGINT) AS sats, coalesce(max(n) FILTER (WHERE sys = 'G'), 0) AS G, coalesce(max(n) FILTER (WHERE sys = 'E'), 0) AS E,
 coalesce(max(n) FILTER (WHERE sys = 'R'), 0) AS R, coalesce(max(n) FILTER (WHERE sys = 'C'), 0) AS C FROM p GROUP BY ALL)
SELECT day AS file, count(*) AS count, max(sats) AS max_sats, max(G) AS G, max(E) AS E, max(R) AS R, max(C) AS C FROM t GROUP BY day""")
def obs_maxima_command(spark, sf_dir):
    return cli.maxima(scanning.scan_records(station.station_files(spark, sf_dir, 3, False)), False)[-1]


@query(SCAN.replace("CAST(0 AS BIGINT) AS sysobs", "CAST(5 AS BIGINT) AS sysobs").replace("'empty', 0, 0, 0, 0", "'empty', 0, 0, 0, 5"))
def obs_scan_v2(spark, sf_dir):
    """The scan command over files of version 2, whose one list of codes is counted."""
    return cli.scan(scanning.scan_records(station.station_files(spark, sf_dir, 2, False)), False)[-1]


@query(SCAN)
def obs_scan_compact(spark, sf_dir):
    """The scan command over compact files, whose values are decoded first."""
    return cli.scan(scanning.scan_records(station.station_files(spark, sf_dir, 3, True)), False)[-1]


LABEL = "SYS / # / OBS TYPES"


@query(ST + """SELECT f AS file, 'G    5 C1C L1C D1C S1C C5Q' AS body, 2 AS line_no, CAST(9 AS BIGINT) AS n_lines FROM (SELECT DISTINCT day AS f FROM x UNION SELECT day FROM u UNION SELECT 'empty')""")
def obs_header_lookup(spark, sf_dir):
    """The first line of a label in each file, and how many lines the cleaned header has."""
    got = reading(spark, sf_dir, 3)
    lines = got.headers.where(F.length(F.rtrim("line")).between(61, 80)).groupBy("file").agg(F.count("*").alias("n_lines"))
    return text.find_header(got.headers, LABEL).join(lines, "file").select("file", "body", "line_no", "n_lines")


# Files, streams and commands ------------------------------------------------------------------------


def in_folder(spark: SparkSession, sf_dir: str, version: int, packed: bool) -> str:
    """A folder with a text file for each station file, under names of the engine's own."""
    path = Scratch(spark, "stations").path("text")
    station.station_files(spark, sf_dir, version, packed).select(F.rtrim("content", F.lit("\n"))).write.option("maxRecordsPerFile", 1).text(path)
    return path


@query(IDENTITY)
def obs_glob_scan(spark, sf_dir):
    """Files found by a glob and read in pieces, the plain ones."""
    return whole(spark, sf_dir, text.read_text(spark, in_folder(spark, sf_dir, 3, False) + "/*.txt"))


@query(IDENTITY)
def obs_whole_file_scan(spark, sf_dir):
    """The same through the engine's reader of whole files, compact ones."""
    return whole(spark, sf_dir, text.read_text(spark, in_folder(spark, sf_dir, 2, True) + "/*.txt", whole_files=True))


@query("SELECT file, epoch_idx, sys, prn, sv, code_idx, code, value_e3, lli, ssi FROM o WHERE hour // 24 = (SELECT min(hour) // 24 FROM o)")
def obs_spooled_scan(spark, sf_dir):
    """The first day's file as a byte stream, such as standard input, copied piece by piece and read."""
    first = station.station_files(spark, sf_dir, 3, False).where(f"file <> '{station.EMPTY}'").orderBy("file").first()
    name = f"one-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    return whole(spark, sf_dir, text.read_text(spark, text.spool(spark, io.BytesIO(first["content"].encode() if first else b""), name)))


@query(IDENTITY)
def obs_stream_files(spark, sf_dir):
    """Compact files that come in micro-batches, each batch's observations appended to a table."""
    folder, scratch = in_folder(spark, sf_dir, 3, True), Scratch(spark, "stream")

    def use(got: text.Reading, n: int) -> None:
        whole(spark, sf_dir, got).write.mode("overwrite").parquet(scratch.path(f"batches/n={n}"))

    st.for_each_file_batch(st.stream_files(spark, folder, 20), use, scratch.path("checkpoint")).awaitTermination()
    schema = "file string, epoch_idx bigint, sys string, prn int, sv string, code_idx int, code string, value_e3 bigint, lli string, ssi string"
    return spark.read.schema(schema).parquet(scratch.path("batches")).drop("n")


@query("SELECT file, sv, code, epoch_idx, value_e3 FROM o")
def obs_stream_decode(spark, sf_dir):
    """Signals as streams of tokens over two batches, decoded with state."""
    scratch = Scratch(spark, "decode")
    items = compact.encode_items(observations(spark, sf_dir), an.SIGNAL, "epoch_idx", "value_e3", 4)
    token = F.when(F.col("k") == 0, F.concat(F.col("n").cast("string"), F.lit("&"), F.col("item").cast("string"))).otherwise(F.col("item").cast("string"))
    rows = scratch.save(items.select(*an.SIGNAL, "epoch_idx", token.alias("token")), "tokens")
    middle = rows.agg((F.min("epoch_idx") + F.max("epoch_idx")) / 2).first()[0] or 0
    for cond in (f"epoch_idx <= {middle}", f"epoch_idx > {middle}"):
        rows.where(cond).coalesce(1).write.mode("append").parquet(scratch.path("parts"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(scratch.path("parts"))
    st.decode_stream(stream).writeStream.format("parquet").option("path", scratch.path("out")).option("checkpointLocation", scratch.path("checkpoint")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(st.DECODED).parquet(scratch.path("out"))


@query("SELECT file, count(*) AS n, CAST(max(value_e3) AS BIGINT) AS top FROM o GROUP BY file")
def obs_per_file_callback(spark, sf_dir):
    """A fold of a file's rows in Python."""
    return an.per_file(observations(spark, sf_dir), lambda part: part.groupby("file", as_index=False).agg(n=("value_e3", "size"), top=("value_e3", "max")), "file string, n bigint, top bigint")


# Stores ---------------------------------------------------------------------------------------------


def stores(spark: SparkSession, sf_dir: str):
    """Station files packed into binary stores with digests; a function that loads their tables."""
    path = Scratch(spark, "stores").path("stores")
    convert.pack(reading(spark, sf_dir, 3), path)
    signal_store.register(spark)
    return path, lambda table: spark.read.format("signalstore").option("table", table).load(path).withColumn("file", F.regexp_replace("file", "[.]srnx$", ""))


def stamped(epochs: DataFrame) -> DataFrame:
    return epochs.withColumn("ts", fn.packed_timestamp(F.col("date"), F.col("hh_mm"), F.col("sec_e7")))


@query(IDENTITY)
def store_station_roundtrip(spark, sf_dir):
    _, load = stores(spark, sf_dir)
    return back(spark, sf_dir, load("observations"), stamped(load("epochs")))


@query(ST + "SELECT DISTINCT day AS file, hour, coalesce(clock, 0) AS clock_offset_e12 FROM x")
def store_epochs(spark, sf_dir):
    """Epochs of a store: spans of a common interval, and clock offsets by runs."""
    _, load = stores(spark, sf_dir)
    return stamped(load("epochs")).select("file", view.hour(F.col("ts")).alias("hour"), "clock_offset_e12")


@query(EVENTS.replace("u.flag, ", "").replace(", 1 AS n_lines", ", CAST(row_number() OVER (PARTITION BY u.day ORDER BY u.hour, u.event_id) - 1 AS INTEGER) AS place"))
def store_events(spark, sf_dir):
    """Special events of a store, in the order of their epochs."""
    _, load = stores(spark, sf_dir)
    from pyspark.sql import Window as W

    number = F.split("text", "\n")[1]
    place = F.row_number().over(W.partitionBy("file").orderBy("epoch_idx", F.substring(number, 6, 20).cast("bigint"))) - 1
    return load("events").select("file", number.alias("note"), "epoch_idx", place.alias("place"))


@query(ST + "SELECT f AS file, " + " || chr(10) || ".join(f"'{x.rstrip()}'" for x in text.header_lines(3, NAMES[3], SYSTEMS)) + " AS text FROM (SELECT DISTINCT day AS f FROM x)")
def store_headers(spark, sf_dir):
    _, load = stores(spark, sf_dir)
    return load("headers").select("file", F.rtrim("text", F.lit("\n")).alias("text"))


@query(ST + "SELECT day AS file, sv, count(DISTINCT hour) AS n_epochs, CAST(count(DISTINCT code) AS INTEGER) AS n_codes FROM x GROUP BY day, sv")
def store_satellites(spark, sf_dir):
    _, load = stores(spark, sf_dir)
    return load("satellites").select("file", "sv", "n_epochs", F.size("codes").alias("n_codes"))


@query("SELECT file, epoch_idx, sys, prn, sv, code_idx, code, value_e3, lli, ssi FROM o WHERE sv IN ('R02', 'S03', 'G08') AND code IN ('click', 'view')")
def store_select(spark, sf_dir):
    """Satellites and codes chosen in a store: filters reach the reader, which goes by directory offsets."""
    _, load = stores(spark, sf_dir)
    got = load("observations").where(F.col("sv").isin("R02", "S03", "G08") & F.col("code").isin("C1C", "C5Q"))
    return back(spark, sf_dir, got, stamped(load("epochs")))


ARRAYS = "count(*) AS n, string_agg(CAST(value_e3 AS VARCHAR), ' ' ORDER BY epoch_idx) AS vals, string_agg(lli, '' ORDER BY epoch_idx) AS lli, string_agg(ssi, '' ORDER BY epoch_idx) AS ssi"


def array_columns() -> list:
    return [F.size("values").cast("bigint").alias("n"), F.array_join(F.transform("values", lambda v: v.cast("string")), " ").alias("vals"), F.array_join("lli", "").alias("lli"), F.array_join("ssi", "").alias("ssi")]


@query(f"SELECT file, sv, code, {ARRAYS} FROM o GROUP BY file, sv, code")
def obs_signal_arrays(spark, sf_dir):
    return an.signal_arrays(observations(spark, sf_dir)).select("file", "sv", "code", *array_columns())


@query(ST + f"SELECT day AS file, sv, code, {ARRAYS} FROM x GROUP BY day, sv, code")
def store_signal_arrays(spark, sf_dir):
    """All values and indicators of each signal of a store."""
    _, load = stores(spark, sf_dir)
    code = F.element_at(F.array(*map(F.lit, CODES)), F.col("code_idx") + 1)
    return an.signal_arrays(load("observations").withColumn("code", code)).select("file", "sv", "code", *array_columns())


@query(IDENTITY)
def store_to_text_roundtrip(spark, sf_dir):
    """Text to store, store to text, and that parsed again."""
    path, _ = stores(spark, sf_dir)
    return whole(spark, sf_dir, text.Reading(text.records(convert.unpack(spark, path))))


@query("SELECT file, sv, code, count(*) + CASE WHEN sv < 'G' THEN 1 ELSE 0 END AS expected, count(*) FILTER (WHERE value_e3 <> 0) AS used FROM o GROUP BY file, sv, code HAVING used <> expected")
def obs_used_expected(spark, sf_dir):
    """Signals with fewer or more values than a count says; the count is off by one for some systems."""
    obs = observations(spark, sf_dir)
    counts = obs.groupBy(*an.SIGNAL).agg((F.count("*") + F.when(F.substring("sv", 1, 1) < "G", 1).otherwise(0)).alias("expected"))
    return an.used_versus_expected(obs, counts).select(*an.SIGNAL, "expected", "used")


MANY = ", w AS (SELECT file, sv, epoch_idx, CAST(event_id % 200 AS INTEGER) AS code_idx, value_e3 FROM r)\n"


def many_codes(spark, sf_dir) -> DataFrame:
    return raw(spark, sf_dir).withColumn("code_idx", (F.col("event_id") % 200).cast("int"))


@query(MANY + "SELECT file, sv, CAST(code_idx // 63 AS INTEGER) AS word, coalesce(bit_or(CAST(1 AS BIGINT) << (code_idx % 63)) FILTER (WHERE value_e3 <> 0), 0) AS mask, CAST(count(DISTINCT code_idx) FILTER (WHERE value_e3 <> 0) AS INTEGER) AS n_codes FROM w GROUP BY ALL")
def obs_presence_mask_many(spark, sf_dir):
    """Presence of 200 codes."""
    return an.presence_masks(many_codes(spark, sf_dir))


@query(MANY + """, p AS (SELECT epoch_idx, count(DISTINCT sv) AS sats, count(*) FILTER (WHERE value_e3 <> 0) AS n FROM w GROUP BY epoch_idx), s AS (SELECT sv, count(DISTINCT epoch_idx) AS n FROM w GROUP BY sv)
SELECT 'events' AS file, count(*) AS epochs, max(n) AS maxobs, max(sats) AS maxsats, 0 AS sysobs, (SELECT count(DISTINCT (sv, code_idx)) FROM w WHERE value_e3 <> 0) AS satobs, CAST(sum(n) AS BIGINT) AS totobs, (SELECT max(n) FROM s) AS maxepochs FROM p HAVING count(*) > 0""")
def obs_scan_summary_many(spark, sf_dir):
    return an.scan_summary(many_codes(spark, sf_dir))


# Fields ---------------------------------------------------------------------------------------------


@query("""SELECT event_id, sys, CAST(ascii(sys) & 31 AS INTEGER) AS system_hash, sys || lpad(CAST(prn AS VARCHAR), 2, '0') AS name, prn AS number,
CAST(CASE WHEN prn < 80 THEN 20000000 ELSE 19000000 END + prn * 10000 + 102 AS INTEGER) AS date, CAST((hour % 24) * 100 + event_id % 60 AS SMALLINT) AS hh_mm, CAST((event_id % 600) * 1000000 AS INTEGER) AS sec_e7,
CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 THEN 3 ELSE 0 END AS version, CAST(CASE WHEN event_id % 32 = 0 THEN 0 ELSE 1 << (event_id % 32 & 7) END AS INTEGER) AS digest FROM r""")
def obs_packed_fields(spark, sf_dir):
    """Satellite names, system hashes, packed dates and times, versions by file name, digest lengths."""
    r, e = raw(spark, sf_dir), F.col("event_id")
    name = F.when(e % 3 == 0, F.concat(F.lit("/x/abcd"), F.format_string("%04d", e % 10000), F.lit(".24O"))).when(e % 3 == 1, F.lit("file:/ABCD00XXX_R.rnx")).otherwise(F.lit("abcd.24o"))
    time = (F.col("hour") % 24) * 100_000_000_000 + (e % 60) * 1_000_000_000 + (e % 600) * 1_000_000
    hh_mm, sec = fn.split_time(time)
    short = F.col("prn") * 10000 + 102
    sv = fn.sv_name(F.col("sys"), F.col("prn"))
    return r.select(
        "event_id", "sys", fn.system_hash(F.col("sys")).alias("system_hash"), sv.alias("name"), fn.sv_prn(sv).alias("number"), fn.expand_date(short).cast("int").alias("date"),
        hh_mm.alias("hh_mm"), sec.alias("sec_e7"), F.coalesce(fn.file_version(name), F.lit(0)).alias("version"), fn.digest_length((e % 32).cast("int")).alias("digest"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'empty' WHEN event_id % 4 = 1 THEN 'start' WHEN event_id % 4 = 2 THEN 'delta' ELSE 'bad' END AS kind,
CASE WHEN event_id % 4 = 1 THEN CAST(event_id % 10 AS VARCHAR) WHEN event_id % 4 = 2 THEN CAST(-value_e3 AS VARCHAR) WHEN event_id % 4 = 3 THEN CAST(value_e3 AS VARCHAR) ELSE '' END AS number FROM r""")
def obs_compact_fields(spark, sf_dir):
    """Fields of compact text: their kind, and the number with which they begin."""
    e, v = F.col("event_id"), F.col("value_e3")
    token = F.when(e % 4 == 0, "").when(e % 4 == 1, F.concat((e % 10).cast("string"), F.lit("&"), v.cast("string"))).when(e % 4 == 2, (-v).cast("string")).otherwise(F.concat(v.cast("string"), F.lit("x")))
    return raw(spark, sf_dir).select("event_id", fn.crx_kind(token).alias("kind"), F.coalesce(fn.crx_int(token).cast("string"), F.lit("")).alias("number"))
