"""The observation view: the `events` table read as observations of satellites by epochs.

Epochs are hours, counted from the first; users are satellites, event types are codes; of several
events of one satellite, code and epoch the one of the largest value counts, ties to the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.session import table

CODES = ("click", "error", "purchase", "signup", "view")
#: The codes' names in rendered files, by index.
NAMES = {3: ("C1C", "L1C", "D1C", "S1C", "C5Q"), 2: ("C1", "L1", "D1", "S1", "C5", "L5")}
SYSTEMS = "GRSECJI"
FILE = "events"


def hour(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 3600).cast("bigint")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its observation columns."""
    e = table(spark, sf_dir, "events").withColumn("hour", hour(F.col("ts")))
    first = e.agg(F.min("hour")).first()[0] or 0
    prn, system = F.col("user_id") % 99 + 1, F.substring(F.lit(SYSTEMS), (F.col("user_id") % 7 + 1).cast("int"), F.lit(1))
    return e.select(
        F.lit(FILE).alias("file"), "event_id", "ts", "hour", (F.col("hour") - first).alias("epoch_idx"), system.alias("sys"), prn.cast("int").alias("prn"),
        F.concat(system, F.lpad(prn.cast("string"), 2, "0")).alias("sv"), F.col("event_type").alias("code"),
        (F.array_position(F.array(*map(F.lit, CODES)), F.col("event_type")) - 1).cast("int").alias("code_idx"),
        F.round(F.col("value") * 1000).cast("bigint").alias("value_e3"),
        (F.get_json_object("props", "$.k").cast("bigint") % 8).cast("string").alias("lli"),
        F.least(F.greatest(F.floor(F.col("value") / 6), F.lit(0)), F.lit(9)).cast("string").alias("ssi"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["file", "epoch_idx", "hour", "sys", "prn", "sv", "code_idx", "code"]
    best = F.max(F.struct("value_e3", (-F.col("event_id")).alias("back"), "lli", "ssi")).alias("best")
    return raw(spark, sf_dir).groupBy(*keys).agg(best).select(*keys, "best.value_e3", "best.lli", "best.ssi")


#: The same in SQL: `r` and `o` for raw events and observations.
SQL = """
e AS (SELECT *, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour FROM events),
r AS (SELECT 'events' AS file, event_id, ts, hour, hour - (SELECT min(hour) FROM e) AS epoch_idx, substr('GRSECJI', CAST(user_id % 7 + 1 AS INTEGER), 1) AS sys,
        CAST(user_id % 99 + 1 AS INTEGER) AS prn, substr('GRSECJI', CAST(user_id % 7 + 1 AS INTEGER), 1) || lpad(CAST(user_id % 99 + 1 AS VARCHAR), 2, '0') AS sv,
        event_type AS code, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS INTEGER) AS code_idx,
        CAST(round(value * 1000) AS BIGINT) AS value_e3, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 8 AS VARCHAR) AS lli,
        CAST(least(greatest(CAST(floor(value / 6) AS BIGINT), 0), 9) AS VARCHAR) AS ssi FROM e),
o AS (SELECT file, epoch_idx, hour, sys, prn, sv, code_idx, code, value_e3, lli, ssi FROM r
      QUALIFY row_number() OVER (PARTITION BY epoch_idx, sv, code ORDER BY value_e3 DESC, event_id) = 1)
"""
