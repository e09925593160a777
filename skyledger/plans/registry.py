"""All queries over the observation view, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.functions import fields as fn
from skyledger.operators import analytics as an
from skyledger.plans import view
from skyledger.plans.view import CODES, NAMES, SQL, SYSTEMS, observations, raw
from skyledger.scratch import Scratch
from skyledger.sources import compact, text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL that may use the tables `r` and `o` of the view."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {SQL}{sql}"
        return f

    return register


def daily(obs: DataFrame) -> DataFrame:
    """Observations in files of a day each, named by the day's number."""
    return obs.withColumn("file", F.format_string("d%05d", F.floor(F.col("hour") / 24)))


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by daily file and system, as headers of such files would list them."""
    return daily(observations(spark, sf_dir)).select("file", F.lit("3").alias("version"), "sys", "code_idx", "code").distinct()


def rendered(spark: SparkSession, sf_dir: str, version: int) -> text.Reading:
    """The view written as text files of a day each, and read again."""
    obs = daily(observations(spark, sf_dir)).withColumn("t", F.timestamp_seconds(F.col("hour") * 3600))
    return text.Reading(text.records(text.render_files(obs, NAMES[version], SYSTEMS, version)))


def read_back(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """Observations parsed from the rendered files, under the view's codes and epochs."""
    got = rendered(spark, sf_dir, version)
    first = raw(spark, sf_dir).agg(F.min("hour")).first()[0] or 0
    hours = got.epochs.select("file", "epoch_idx", (view.hour(F.col("ts")) - first).alias("hour_idx"))
    code = F.element_at(F.array(*map(F.lit, CODES)), F.col("code_idx") + 1)
    return got.observations.join(hours, ["file", "epoch_idx"]).select(F.lit(view.FILE).alias("file"), F.col("hour_idx").alias("epoch_idx"), "sys", "prn", "sv", "code_idx", code.alias("code"), "value_e3", "lli", "ssi")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.scan_summary(read_back(spark, sf_dir, 3))


SCAN = """, s AS (SELECT sv, count(DISTINCT epoch_idx) AS n FROM o GROUP BY sv),
p AS (SELECT epoch_idx, count(DISTINCT sv) AS sats, count(*) FILTER (WHERE value_e3 <> 0) AS n FROM o GROUP BY epoch_idx)
SELECT 'events' AS file, count(*) AS epochs, max(n) AS maxobs, max(sats) AS maxsats, 0 AS sysobs,
       (SELECT count(DISTINCT (sv, code)) FROM o WHERE value_e3 <> 0) AS satobs, CAST(sum(n) AS BIGINT) AS totobs, (SELECT max(n) FROM s) AS maxepochs FROM p HAVING count(*) > 0
"""


@query(SCAN)
def obs_scan_summary(spark, sf_dir):
    return an.scan_summary(observations(spark, sf_dir))


@query(SCAN)
def obs_scan_summary_text(spark, sf_dir):
    return flagship(spark, sf_dir)


@query("""SELECT file, epoch_idx, CAST(strftime(make_timestamp(hour * 3600000000), '%Y%m%d') AS INTEGER) AS date, CAST((hour % 24) * 100 AS SMALLINT) AS hh_mm, 0 AS sec_e7,
count(DISTINCT sv) AS n_sats, count(*) FILTER (WHERE value_e3 <> 0) AS n_obs FROM o GROUP BY file, epoch_idx, hour""")
def obs_epoch_counts(spark, sf_dir):
    obs = observations(spark, sf_dir)
    first = raw(spark, sf_dir).agg(F.min("hour")).first()[0] or 0
    t = F.timestamp_seconds((F.col("epoch_idx") + first) * 3600)
    out = an.epoch_counts(obs)
    return out.select("file", "epoch_idx", F.date_format(t, "yyyyMMdd").cast("int").alias("date"), fn.pack_minute(F.hour(t), F.minute(t)).alias("hh_mm"), F.lit(0).alias("sec_e7"), "n_sats", "n_obs")


@query(""", p AS (SELECT file, epoch_idx, sys, count(DISTINCT sv) AS n FROM o GROUP BY ALL),
t AS (SELECT file, epoch_idx, CAST(sum(n) AS BIGINT) AS sats, coalesce(max(n) FILTER (WHERE sys = 'G'), 0) AS G, coalesce(max(n) FILTER (WHERE sys = 'E'), 0) AS E,
 coalesce(max(n) FILTER (WHERE sys = 'R'), 0) AS R, coalesce(max(n) FILTER (WHERE sys = 'C'), 0) AS C FROM p GROUP BY ALL)
SELECT file, count(*) AS count, max(sats) AS max_sats, max(G) AS G, max(E) AS E, max(R) AS R, max(C) AS C FROM t GROUP BY file""")
def obs_constellation_maxima(spark, sf_dir):
    return an.constellation_maxima(observations(spark, sf_dir))


@query(""", p AS (SELECT file, sys, epoch_idx, count(DISTINCT sv) AS n_sats FROM o GROUP BY ALL)
SELECT file, sys, epoch_idx, n_sats FROM p QUALIFY n_sats > coalesce(max(n_sats) OVER (PARTITION BY file, sys ORDER BY epoch_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)""")
def obs_running_max_trace(spark, sf_dir):
    return an.running_maxima(observations(spark, sf_dir))


@query(", t AS (SELECT hour // 24 AS file, sys, count(DISTINCT code) AS n FROM o GROUP BY ALL) SELECT sys AS key, max(n) AS max_codes FROM t GROUP BY sys")
def obs_code_count_max(spark, sf_dir):
    return an.code_count_maxima(types(spark, sf_dir))


@query(""", t AS (SELECT hour // 24 AS file, sys, least(count(DISTINCT code), 128) AS n FROM o GROUP BY ALL), c AS (SELECT n, count(*) AS files FROM t GROUP BY n)
SELECT b.n, coalesce(files, 0) AS files FROM (SELECT unnest(range(128)) AS n) b LEFT JOIN c USING (n)""")
def obs_code_count_hist(spark, sf_dir):
    return an.code_count_histogram(types(spark, sf_dir))


@query("""SELECT file, sv, 0 AS word, coalesce(bit_or(CAST(1 AS BIGINT) << code_idx) FILTER (WHERE value_e3 <> 0), 0) AS mask,
CAST(bit_count(coalesce(bit_or(CAST(1 AS BIGINT) << code_idx) FILTER (WHERE value_e3 <> 0), 0)) AS INTEGER) AS n_codes FROM o GROUP BY file, sv""")
def obs_presence_mask(spark, sf_dir):
    return an.presence_masks(observations(spark, sf_dir))


DAYS = ", days AS (SELECT DISTINCT file, sv, epoch_idx // 24 AS d FROM o), i AS (SELECT *, d - row_number() OVER (PARTITION BY file, sv ORDER BY d) AS g FROM days)\n"


def by_day(spark, sf_dir) -> DataFrame:
    return observations(spark, sf_dir).withColumn("epoch_idx", F.floor(F.col("epoch_idx") / 24))


@query(DAYS + """, s AS (SELECT file, sv, min(d) AS start, count(*) AS count FROM i GROUP BY file, sv, g)
SELECT file, sv, CAST(row_number() OVER (PARTITION BY file, sv ORDER BY start) - 1 AS INTEGER) AS run_idx, start, count FROM s""")
def obs_runs(spark, sf_dir):
    return an.presence_runs(by_day(spark, sf_dir))


@query(DAYS + "SELECT file, sv, d AS epoch_idx FROM days")
def obs_presence_expand(spark, sf_dir):
    return an.expand_runs(an.presence_runs(by_day(spark, sf_dir)))


DIFFS = """, d0 AS (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS ord, value_e3 - lag(value_e3) OVER w AS d1 FROM o WINDOW w AS (PARTITION BY file, sv, code ORDER BY epoch_idx)),
dd2 AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY file, sv, code ORDER BY epoch_idx) AS d2 FROM d0), dd3 AS (SELECT *, d2 - lag(d2) OVER (PARTITION BY file, sv, code ORDER BY epoch_idx) AS d3 FROM dd2),
dd4 AS (SELECT *, d3 - lag(d3) OVER (PARTITION BY file, sv, code ORDER BY epoch_idx) AS d4 FROM dd3), d AS (SELECT *, d4 - lag(d4) OVER (PARTITION BY file, sv, code ORDER BY epoch_idx) AS d5 FROM dd4)
"""
LEVELS = ", lv AS (" + " UNION ALL ".join(f"SELECT {n} AS level, d{n} AS d FROM d WHERE d{n} IS NOT NULL" for n in range(1, 6)) + ")\n"


def sleb_sql(v: str) -> str:
    zig = f"(CASE WHEN {v} >= 0 THEN 2 * CAST({v} AS HUGEINT) ELSE -2 * CAST({v} AS HUGEINT) - 1 END)"
    return "CASE " + " ".join(f"WHEN {zig} < {2 ** (7 * n)} THEN {n}" for n in range(1, 10)) + " ELSE 10 END"


@query(DIFFS + "SELECT file, sv, code, epoch_idx, ord, value_e3, " + ", ".join(f"coalesce(d{n}, 0) AS d{n}" for n in range(1, 6)) + " FROM d")
def obs_diff_orders(spark, sf_dir):
    return an.difference_orders(observations(spark, sf_dir)).select("file", "sv", "code", "epoch_idx", "ord", "value_e3", *[F.coalesce(f"d{n}", F.lit(0)).alias(f"d{n}") for n in range(1, 6)])


COSTS = DIFFS + ", c AS (SELECT file, sv, code, " + ", ".join(f"CAST(sum({sleb_sql('coalesce(' + ', '.join([f'd{k}' for k in range(n, 0, -1)] + ['value_e3']) + ')')}) AS BIGINT) AS l{n}" for n in range(6)) + ", count(*) AS n FROM d GROUP BY ALL)\n"


@query(COSTS + "SELECT *, least(l0, l1, l2, l3, l4, l5) AS best FROM c")
def obs_delta_cost(spark, sf_dir):
    return an.delta_costs(observations(spark, sf_dir))


@query(DIFFS + LEVELS + "SELECT level, least(0, min(d)) AS lo, greatest(0, max(d)) AS hi FROM lv GROUP BY level")
def obs_zrange(spark, sf_dir):
    return an.zero_ranges(observations(spark, sf_dir))


@query(DIFFS + LEVELS + """SELECT level, CAST(CASE WHEN d IN (0, -1) THEN 63 ELSE 63 - length(bin(CASE WHEN d < 0 THEN -d - 1 ELSE d END)) END AS INTEGER) AS bits, count(*) AS n FROM lv GROUP BY ALL""")
def obs_lrsb_hist(spark, sf_dir):
    return an.sign_bit_histogram(observations(spark, sf_dir))


def rle_sql(c: str) -> str:
    return f""", {c}1 AS (SELECT file, sv, code, epoch_idx, {c}, CASE WHEN {c} IS NOT DISTINCT FROM lag({c}) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY file, sv, code ORDER BY epoch_idx)),
{c}2 AS (SELECT *, sum(new) OVER (PARTITION BY file, sv, code ORDER BY epoch_idx) AS run FROM {c}1), {c}3 AS (SELECT file, sv, code, run, count(*) AS len FROM {c}2 GROUP BY ALL),
{c}4 AS (SELECT file, sv, code, CAST(sum(1 + CASE WHEN len - 1 < 128 THEN 1 WHEN len - 1 < 16384 THEN 2 ELSE 3 END) AS BIGINT) AS {c}_cost FROM {c}3 GROUP BY ALL)
"""


@query(rle_sql("lli") + rle_sql("ssi") + "SELECT file, sv, code, lli_cost, ssi_cost FROM lli4 JOIN ssi4 USING (file, sv, code)")
def obs_rle_cost(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return an.run_length_costs(obs, "lli", "lli_cost").join(an.run_length_costs(obs, "ssi", "ssi_cost"), an.SIGNAL)


@query(COSTS + rle_sql("lli") + rle_sql("ssi") + """, sg AS (SELECT file, count(*) AS n_signals, CAST(sum(lli_cost + ssi_cost + 1 + least(l0, l1, l2, l3, l4, l5)) AS BIGINT) AS signal_bytes FROM c JOIN lli4 USING (file, sv, code) JOIN ssi4 USING (file, sv, code) GROUP BY file),
i AS (SELECT file, sv, epoch_idx, epoch_idx - row_number() OVER (PARTITION BY file, sv ORDER BY epoch_idx) AS g FROM (SELECT DISTINCT file, sv, epoch_idx FROM o)),
s AS (SELECT file, sv, min(epoch_idx) AS start, count(*) AS cnt FROM i GROUP BY file, sv, g),
gp AS (SELECT *, start - coalesce(lag(start + cnt) OVER (PARTITION BY file, sv ORDER BY start), 0) AS gap FROM s),
rb AS (SELECT file, CAST(sum(CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 ELSE 3 END + CASE WHEN cnt - 1 < 128 THEN 1 WHEN cnt - 1 < 16384 THEN 2 ELSE 3 END) AS BIGINT) AS run_bytes FROM gp GROUP BY file),
ep AS (SELECT file, count(DISTINCT epoch_idx) AS n_epochs FROM o GROUP BY file),
ev AS (SELECT file, CAST(sum(strlen(CAST(event_id AS VARCHAR)) + CASE WHEN epoch_idx < 128 THEN 1 WHEN epoch_idx < 16384 THEN 2 ELSE 3 END) AS BIGINT) AS event_bytes FROM r WHERE code = 'error' GROUP BY file)
SELECT file, n_epochs, n_signals, CAST(0 AS BIGINT) AS header_bytes, coalesce(event_bytes, 0) AS event_bytes, run_bytes, signal_bytes, coalesce(event_bytes, 0) + run_bytes + signal_bytes AS total_bytes
FROM ep JOIN sg USING (file) JOIN rb USING (file) LEFT JOIN ev USING (file)""")
def obs_compression_total(spark, sf_dir):
    special = raw(spark, sf_dir).where("code = 'error'").select("file", "epoch_idx", F.col("event_id").cast("string").alias("text"))
    return an.compression_total(observations(spark, sf_dir), special=special)


@query("SELECT event_id, CAST(round(value * 1000) AS BIGINT) AS value_e3, CAST(user_id AS INTEGER) AS number, CAST(3 + len(CAST(CAST(round(value * 1000) AS BIGINT) AS VARCHAR)) * 0 AS INTEGER) AS good FROM events")
def obs_fixed_roundtrip(spark, sf_dir):
    """Values rendered as F14.3 and numbers as I6, and parsed; `good` counts the three readings that agree."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(F.col("value") * 1000).cast("bigint").alias("v"), F.lpad(F.col("user_id").cast("string"), 6, " ").alias("n"))
    f = e.withColumn("field", fn.render_obs(F.col("v"), F.lit("1"), F.lit("7")))
    f = f.withColumns({"value_e3": fn.obs_value(F.col("field")), "s": fn.obs_struct(F.col("field")), "number": fn.parse_uint("n")})
    good = (F.col("s.value_e3") == F.col("v")).cast("int") + (F.col("s.lli") == "1").cast("int") + (F.col("s.ssi") == "7").cast("int")
    return f.select("event_id", "value_e3", "number", good.alias("good"))


IDENTITY = "SELECT file, epoch_idx, sys, prn, sv, code_idx, code, value_e3, lli, ssi FROM o"


@query(IDENTITY)
def obs_v3_line_roundtrip(spark, sf_dir):
    return read_back(spark, sf_dir, 3)


@query(IDENTITY)
def obs_v2_record_roundtrip(spark, sf_dir):
    return read_back(spark, sf_dir, 2)


@query("SELECT file, sv, code, epoch_idx, value_e3 FROM o")
def obs_hatanaka_roundtrip(spark, sf_dir):
    """Values as differences of order 1 to 9, by the satellite's number, and back by running sums."""
    obs, out = observations(spark, sf_dir), None
    for order in range(1, 10):
        part = compact.encode_items(obs.where(F.col("prn") % 9 + 1 == order), an.SIGNAL, "epoch_idx", "value_e3", order).select(*an.SIGNAL, "epoch_idx", "item", "k", "n")
        out = part if out is None else out.unionByName(part)
    return compact.undo_differences(out, an.SIGNAL, "epoch_idx", "item", "n", "k").select(*an.SIGNAL, "epoch_idx", F.col("value").alias("value_e3"))


@query("SELECT file, sv, code, epoch_idx, lli, ssi FROM o")
def obs_flag_repair(spark, sf_dir):
    """Indicators stored only where they change, and filled forward."""
    w = an.signal_window()
    obs = observations(spark, sf_dir).withColumn("init", F.lag("epoch_idx").over(w).isNull())
    said = {c: F.when(F.col("init"), F.col(c)).when(F.col(c) == F.lag(c).over(w), " ").otherwise(F.regexp_replace(c, " ", "&")) for c in ("lli", "ssi")}
    stored = obs.select(*an.SIGNAL, "epoch_idx", "init", *[x.alias(c) for c, x in said.items()])
    return stored.select(*an.SIGNAL, "epoch_idx", *[compact.fill_flags(F.col("init"), F.col(c), w).alias(c) for c in ("lli", "ssi")])


@query("SELECT file, sv, code, row_number() OVER (PARTITION BY file, sv, code ORDER BY epoch_idx) - 1 AS ord, lli FROM o")
def obs_rle_roundtrip(spark, sf_dir):
    runs = an.run_lengths(observations(spark, sf_dir), "lli")
    return runs.select(*an.SIGNAL, F.explode(F.sequence(F.col("start").cast("bigint"), F.col("start") + F.col("len") - 1)).alias("ord"), F.col("value").alias("lli"))


@query(""", h AS (SELECT DISTINCT file, epoch_idx AS t FROM o), s1 AS (SELECT *, t - lag(t) OVER (PARTITION BY file ORDER BY t) AS step, lag(t) OVER (PARTITION BY file ORDER BY t) AS before FROM h),
s2 AS (SELECT *, CASE WHEN step IS NOT DISTINCT FROM lag(step) OVER (PARTITION BY file ORDER BY t) OR (before IS NOT NULL AND lag(before) OVER (PARTITION BY file ORDER BY t) IS NULL) THEN 0 ELSE 1 END AS new FROM s1),
s3 AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY t) AS span FROM s2)
SELECT file, min(t) AS start, CASE WHEN count(*) > 1 THEN (max(t) - min(t)) // (count(*) - 1) ELSE 0 END AS interval, count(*) AS count FROM s3 GROUP BY file, span""")
def obs_epoch_spans(spark, sf_dir):
    return an.epoch_spans(observations(spark, sf_dir).select("file", F.col("epoch_idx").alias("t")).distinct())


@query(""", k AS (SELECT DISTINCT epoch_idx FROM o WHERE code <> 'error')
SELECT event_id, r.epoch_idx AS at, (SELECT min(epoch_idx) FROM k WHERE k.epoch_idx >= r.epoch_idx) AS before_epoch FROM r WHERE code = 'error'""")
def obs_events_before_epoch(spark, sf_dir):
    special = raw(spark, sf_dir).where("code = 'error'").select("file", "event_id", F.col("epoch_idx").alias("at"))
    epochs = observations(spark, sf_dir).where("code <> 'error'").select("file", "epoch_idx").distinct()
    return an.before_epoch(special, epochs).select("event_id", "at", "before_epoch")


@query(""", n AS (SELECT file, epoch_idx, sv, CAST(row_number() OVER (PARTITION BY file, epoch_idx ORDER BY sv) - 1 AS INTEGER) AS sv_pos FROM (SELECT DISTINCT file, epoch_idx, sv FROM o))
SELECT n.file, n.epoch_idx, n.sv, n.sv_pos, coalesce(p.sv_pos, -1) AS prev_pos FROM n LEFT JOIN n p ON n.file = p.file AND n.sv = p.sv AND n.epoch_idx = p.epoch_idx + 1""")
def obs_sat_reorder(spark, sf_dir):
    return an.satellite_order(observations(spark, sf_dir))


@query(""", t AS (SELECT DISTINCT 'd' || lpad(CAST(hour // 24 AS VARCHAR), 5, '0') AS file, sys, code FROM o)
SELECT a.file, a.sys, a.code FROM (SELECT DISTINCT file, sys, unnest(['click', 'signup', 'L1X', 'refund']) AS code FROM t) a ANTI JOIN t USING (file, sys, code)""")
def obs_unknown_codes(spark, sf_dir):
    return an.unknown_codes(types(spark, sf_dir), ["click", "signup", "L1X", "refund"])


@query("SELECT file, epoch_idx, sv, code, CAST(value_e3 AS DOUBLE) * 0.001 AS value, lli, ssi FROM o WHERE sv IN ('R02', 'S03') AND code IN ('click', 'view')")
def obs_select_signal(spark, sf_dir):
    got = an.select_signals(observations(spark, sf_dir), ["R02", "S03"], ["click", "view"])
    return got.select("file", "epoch_idx", "sv", "code", fn.scaled_double(F.col("value_e3")).alias("value"), "lli", "ssi")


@query(""", s1 AS (SELECT sv, epoch(ts) AS t, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w < 21600 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY sv ORDER BY epoch(ts))),
s2 AS (SELECT *, sum(new) OVER (PARTITION BY sv ORDER BY t ROWS UNBOUNDED PRECEDING) AS pass FROM s1)
SELECT sv, CAST(floor(min(t)) AS BIGINT) AS start, CAST(floor(max(t)) AS BIGINT) + 21600 AS "end", count(*) AS n FROM s2 GROUP BY sv, pass""")
def obs_pass_sessions(spark, sf_dir):
    """Passes: stretches of events of a satellite with less than six hours between."""
    from skyledger.streaming.passes import passes

    got = passes(raw(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), gap="6 hours")
    return got.select("sv", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), "n")


#: Malformed records in the layouts of both versions; expected results are in the SQL.
BAD_FILES = {
    "v2": [" 24  x  1  0  0  0.0000000  0  1G01", "     20000.000", " 24  1  1  0  0  2.0000000  0  1G01", "     20001.500 7", " 24  1  1  0  0  3.0000000  0  1G01", "     2000a.500", " 24  1  1  0  0  4.0000000  0  1G01", "     20002.000", " 24  1  1  0  0  5.0000000  0  1G01"],
    "v3": ["> 2024 0x 01 00 00  1.0000000  0  1", "G01     20000.000", "> 2024 01 01 00 00  2.0000000  0  1", "G01     20001.500 7", "> 2024 01 01 00 00  3.0000000  0  1", "G01     20001.500 7                     x", "> 2024 01 01 00 00  4.0000000  0  1      -1.012345678901", "G01     20002.000", "> 2024 01 01 00 00  5.0000000  2  1", "a note"],
}


@query("""SELECT * FROM (VALUES ('v2', 0, 'BAD_FORMAT', 'epoch line'), ('v2', 2, 'BAD_FORMAT', 'observation field'), ('v2', 4, 'BAD_FORMAT', 'end of file within a record'),
('v3', 0, 'BAD_FORMAT', 'epoch line'), ('v3', 2, 'BAD_FORMAT', 'text after the last field')) t(file, rec_idx, error, reason)""".replace("SELECT *", "SELECT file, CAST(rec_idx AS BIGINT) AS rec_idx, error, reason"))
def obs_parse_errors(spark, sf_dir):
    rows = [(name, "\n".join([*text.header_lines(2 if name == "v2" else 3, ("C1",) if name == "v2" else ("C1C",), "G"), *lines]) + "\n") for name, lines in BAD_FILES.items()]
    got = text.Reading(text.records(spark.createDataFrame(rows, "file string, content string")))
    return got.parse_errors.select("file", "rec_idx", "error", "reason")


@query(IDENTITY + " WHERE value_e3 <> 0 OR lli <> ' ' OR ssi <> ' '")
def signal_store_roundtrip(spark, sf_dir):
    """The view written to binary files of a day each, with digests, and read back through the data source."""
    from skyledger.sources import signal_store as store

    obs = daily(observations(spark, sf_dir))
    first = raw(spark, sf_dir).agg(F.min("hour")).first()[0] or 0
    t = F.timestamp_seconds(F.col("hour") * 3600)
    epochs = obs.select("file", "epoch_idx", "hour").distinct().select("file", "epoch_idx", F.date_format(t, "yyyyMMdd").cast("int").alias("date"), (F.hour(t) * 100).alias("hh_mm"), F.lit(0).alias("sec_e7"), F.lit(0).cast("bigint").alias("clock"))
    head = "\n".join(text.header_lines(3, NAMES[3], SYSTEMS)) + "\n"
    coded = obs.withColumn("code", F.element_at(F.array(*map(F.lit, NAMES[3])), F.col("code_idx") + 1))
    headers = obs.select("file").distinct().withColumn("text", F.lit(head))
    path = Scratch(spark, "stores").path("stores")
    store.write_stores(store.encode_stores(coded, epochs, headers, chunk_digest=2, file_digest=6), path)
    store.register(spark)
    load = lambda table: spark.read.format("signalstore").option("table", table).load(path)
    e = load("epochs").select("file", "epoch_idx", (F.expr("unix_seconds(to_timestamp(format_string('%08d %04d', date, hh_mm), 'yyyyMMdd HHmm')) div 3600") - first).alias("hour_idx"))
    code = F.element_at(F.array(*map(F.lit, CODES)), F.col("code_idx") + 1)
    return load("observations").join(e, ["file", "epoch_idx"]).select(F.lit(view.FILE).alias("file"), F.col("hour_idx").alias("epoch_idx"), "sys", "prn", "sv", "code_idx", code.alias("code"), "value_e3", "lli", "ssi")
