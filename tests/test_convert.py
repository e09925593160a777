"""Text to binary and back: the same observations, epochs and events."""

import pytest
from pyspark.sql import functions as F

from skyledger import cli
from skyledger.operators import analytics as an
from skyledger.sources import convert, text
from tests.test_sources import expected, got, plain, reading, sample


@pytest.mark.parametrize("version", [2, 3])
def test_pack_and_unpack(spark, tmp_path, version):
    codes, data = sample(3, version, 6)
    lines = plain(version, codes, data).split("\n")
    end = next(i for i, x in enumerate(lines) if "END OF HEADER" in x) + 1
    event = " " * 28 + "4  1" if version == 2 else ">" + " " * 30 + "4  1"
    lines[end:end] = [event, "a note before the first epoch"]
    files = {"a": "\n".join(lines)}
    one = reading(spark, files)
    assert convert.pack(one, str(tmp_path / "s")) == 1
    back = convert.unpack(spark, str(tmp_path / "s"))
    two = text.Reading(text.records(back))
    zero = {k: v for k, v in expected(data, codes).items() if v != (0, " ", " ")}
    assert got(two.observations) == zero == got(one.observations)
    time = ["epoch_idx", "date", "hh_mm", "sec_e7", "n_sats"]
    assert sorted(two.epochs.select(*time).collect()) == sorted(one.epochs.select(*time).collect())
    assert [r["text"] for r in two.events.collect()] == [r["text"] for r in one.events.collect()]
    assert two.parse_errors.count() == 0


def test_clock_offset_survives(spark, tmp_path):
    lines = [*text.header_lines(3, ("C1C",), "G"), "> 2024 01 01 00 00  0.0000000  0  1      -1.012345678901", "G01     20000.000", "> 2024 01 01 00 00 30.0000000  0  1", "G01     20000.001"]
    convert.pack(reading(spark, {"c": "\n".join(lines) + "\n"}), str(tmp_path / "s"))
    two = text.Reading(text.records(convert.unpack(spark, str(tmp_path / "s"))))
    assert [r[0] for r in two.epochs.orderBy("epoch_idx").select("clock_offset_e12").collect()] == [-1012345678901, None]


def test_commands(spark, tmp_path):
    codes, data = sample(1, 3, 4)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/abcd0010.24o").write_text(plain(3, codes, data))
    assert cli.main(["pack", "--out", str(tmp_path / "s"), str(tmp_path / "in")]) == 0
    assert (tmp_path / "s/abcd0010.srnx").exists()
    assert cli.main(["unpack", "--out", str(tmp_path / "t"), str(tmp_path / "s")]) == 0
    again = spark.read.text(str(tmp_path / "t"))
    assert again.where(F.col("value").startswith("> 2024")).count() == 4


def test_per_file(spark, sf):
    from skyledger.plans.view import observations

    out = an.per_file(observations(spark, sf), lambda part: part.groupby("file", as_index=False).agg(n=("value_e3", "size")), "file string, n long").first()
    assert out["n"] == observations(spark, sf).count()
