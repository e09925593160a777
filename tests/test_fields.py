"""Fixed-width fields and integer code lengths against plain Python."""

import pytest
from pyspark.sql import functions as F

from skyledger.functions import fields as fn


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_parse_fixed(spark):
    cases = {"4375274.   ": 4375274000, "-.120": -120, ".": 0, "-.": 0, "  12.5": 12500, "1.2345": None, "+1.5": None, "1e3": None, "12": None, "": None, "a3.75": None, "  -0.001\n": -1}
    assert values(spark, fn.parse_fixed("x", 3), list(cases)) == list(cases.values())


def test_parse_uint(spark):
    cases = {"  7": 7, "   ": 0, "": 0, "7 ": None, "-1": None, "12": 12, "0x": None}
    assert values(spark, fn.parse_uint("x"), list(cases)) == list(cases.values())


def test_observation_field_round_trip(spark):
    rows = [(v,) for v in (0, 1, -1, 999, -1000, 128250890432, -1567275, 9999999999999, -999999999999, None)]
    df = spark.createDataFrame(rows, "v bigint").withColumn("f", fn.render_obs(F.col("v"), F.lit("1"), F.lit(" ")))
    got = df.select("v", F.length("f").alias("n"), fn.obs_struct(F.col("f")).alias("s")).collect()
    for r in got:
        assert r["n"] == 16
        assert (r["s"]["value_e3"] if r["s"] else None) == r["v"]


def test_blank_fraction_digits_are_zero(spark):
    assert values(spark, fn.obs_value(F.col("x")), ["     20000.    ", "     20000.5  7"]) == [20000000, 20000500]


def leb(v):
    u = (v << 1) if v >= 0 else ((-v) << 1) - 1
    return max(1, -(-u.bit_length() // 7))


@pytest.mark.parametrize("power", range(0, 63, 3))
def test_code_lengths(spark, power):
    rows = [s * ((1 << power) + d) for s in (1, -1) for d in (-1, 0, 1)] + [2**63 - 1, -(2**63)]
    rows = [max(-(2**63), min(2**63 - 1, x)) for x in rows]
    assert values(spark, fn.sleb_length(F.col("x")), rows, "x bigint") == [leb(x) for x in rows]
    assert values(spark, fn.sign_bits(F.col("x")), rows, "x bigint") == [63 - (x if x >= 0 else ~x).bit_length() for x in rows]
    assert values(spark, fn.unzigzag(fn.zigzag(F.col("x"))), rows, "x bigint") == rows


def test_small_functions(spark):
    row = spark.range(1).select(
        fn.sv_name(F.lit("G"), F.lit(5)), fn.sv_prn(F.lit("R09")), fn.system_hash(F.lit("G")), fn.full_year(F.lit(79)), fn.full_year(F.lit(80)), fn.expand_date(F.lit(200718)),
        fn.expand_date(F.lit(990101)), fn.digest_length(F.lit(0)), fn.digest_length(F.lit(22)), fn.file_version(F.lit("/a/abcd0010.20o")), fn.file_version(F.lit("x.rnx")), fn.crx_int(F.lit("-12abc")),
        fn.crx_kind(F.lit("3&12")), fn.crx_kind(F.lit("")), fn.crx_kind(F.lit("x")), fn.packed_timestamp(F.lit(20200718), F.lit(1234), F.lit(305000000)), *fn.split_time(F.lit(12 * 10**11 + 34 * 10**9 + 5 * 10**7)),
    ).first()
    assert list(row)[:15] == ["G05", 9, 7, 2079, 1980, 20200718, 19990101, 0, 64, 2, None, -12, "start", "empty", "bad"]
    assert str(row[15]) == "2020-07-18 12:34:30.500000" and list(row)[16:] == [1234, 50000000]
