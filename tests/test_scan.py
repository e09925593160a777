"""Scans of lines as byte arrays against the same files framed line by line and read value by value."""

import io
import random

import numpy as np
import pytest

from skyledger.operators import analytics as an
from skyledger.sources import framing, scan, text
from skyledger.sources.framing import Framer, pieces_from
from tests.test_sources import plain, reading, sample


def damaged(content: str, seed: int, times: int) -> str:
    """Characters changed, lines cut, dropped and doubled, below the header."""
    rng = random.Random(seed)
    lines = content.split("\n")
    first = next(k for k, x in enumerate(lines) if "END OF HEADER" in x) + 1
    for _ in range(times):
        k = rng.randrange(first, len(lines) - 1)
        x, at = lines[k], rng.randrange(len(lines[k]) + 1)
        way = rng.randrange(5)
        if way == 0:
            lines[k] = x[:at] + rng.choice(" -.059A\té") + x[at + 1 :]
        elif way == 1:
            lines[k] = x[:at]
        elif way == 2:
            lines[k] = x + rng.choice(["  ", "7", "          12.345"])
        elif way == 3:
            lines.insert(k, x)
        else:
            del lines[k]
    return "\n".join(lines)


def zeros(content: str) -> str:
    """Some values made zero, some with blanks for digits behind the point."""
    rng, out = random.Random(5), []
    for line in content.split("\n"):
        if line[:1] not in ("", ">") and line[60:61] != "R" and rng.random() < 0.2 and line[13:14] == ".":
            line = line[:3] + rng.choice(["         0.000", "          .000", "         -.   ", "         7.5  "]) + line[17:]
        out.append(line)
    return "\n".join(out)


def files(version: int) -> dict[str, str]:
    codes, data = sample(3, version, 40)
    good = plain(version, codes, data)
    return {"good": good, "zeros": zeros(good), "crlf": good.replace("\n", "\r\n"), **{f"bad{k}": damaged(zeros(good), k, 1 + 3 * k) for k in range(12)}}


@pytest.mark.parametrize("version", [2, 3])
def test_framing_is_the_same_line_by_line(version, monkeypatch):
    class Unsure(framing.Fields):
        def __init__(self, *args, **more):
            super().__init__(*args, **more)
            self.good = np.zeros(len(self.filled), bool)

    for name, content in files(version).items():
        fast = list(Framer("f", pieces_from(io.BytesIO(content.encode()), 3000)).rows())
        with monkeypatch.context() as m:
            m.setattr(framing, "Fields", Unsure)
            assert fast == list(Framer("f", content).rows()), name


@pytest.mark.parametrize("version", [2, 3])
def test_words_equal_those_of_observations(spark, version):
    found = files(version)
    rows = spark.createDataFrame(list(found.items()), "file string, content string")
    got, want = scan.scan_records(rows), reading(spark, found)
    columns = ["file", "epoch_idx", "sv", "word", "n", "mask"]
    merged = got.words.groupBy(*columns[:4]).agg(an.F.sum("n").alias("n"), an.F.bit_or("mask").alias("mask"))  # a satellite can stand in an epoch twice
    assert set(map(tuple, merged.collect())) == set(map(tuple, an.by_word(want.observations).select(columns).collect()))
    for table in ("epochs", "events", "headers", "parse_errors"):
        one, two = (sorted(map(str, getattr(x, table).collect())) for x in (got, want))
        assert one == two, table
    summary = ["file", "epochs", "maxobs", "maxsats", "satobs", "totobs", "maxepochs"]
    assert set(map(tuple, an.word_summary(got.words).select(summary).collect())) == set(map(tuple, an.scan_summary(want.observations).select(summary).collect()))


def test_many_codes_and_empty_epochs(spark):
    """Codes beyond 63, one without a name, epochs without satellites, a file without records, no file."""
    codes = tuple(f"C{k % 10}{chr(65 + k // 10)}" for k in range(130))
    top = text.header_lines(3, codes, "G")
    line = "G05" + "".join(f"{k % 7 - 1:d}.000".rjust(14) + "  " if k % 3 else " " * 16 for k in range(130))
    body = ["> 2024 01 02 00 00 30.5000000  0  0", "> 2024 01 02 00 01 30.5000000  0  1", line]
    found = {"a": "\n".join(top + body) + "\n", "b": "\n".join(top) + "\n", "c": "", "d": "\n".join(top).replace(" C0A", "    ") + "\n" + "\n".join(body) + "\n"}
    two = text.header_lines(2, ("C1", "L1"), "G")
    found["e"] = "\n".join([*two, " 24 01 02 00 00 30.5000000  0  0"]) + "\n"
    rows = spark.createDataFrame(list(found.items()), "file string, content string")
    got, want = scan.scan_records(rows), reading(spark, found)
    columns = ["file", "epoch_idx", "sv", "word", "n", "mask"]
    assert sorted(map(tuple, got.words.select(columns).collect())) == sorted(map(tuple, an.by_word(want.observations).select(columns).collect()))
    assert got.epochs.count() == want.epochs.count() == 5
    assert scan.scan_records(rows.limit(0)).words.count() == 0
