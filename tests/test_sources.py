"""Text files of all versions, plain and compact, the binary layout, and malformed input."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyledger.sources import codec, compact, signal_store, text
from skyledger.sources.framing import Framer

CODES = ("C1C", "L1C", "D1C", "S1C", "C5Q", "L5Q")


def reading(spark, files):
    return text.Reading(text.records(spark.createDataFrame(list(files.items()), "file string, content string")))


def sample(seed, version, epochs=12):
    """Epochs with satellites that come and go, gaps, and changing indicators."""
    rng = random.Random(seed)
    value, out = {}, []
    codes = CODES if version == 3 else ("C1", "L1", "D1", "S1", "C5", "L5")
    for k in range(epochs):
        sats = {}
        for sv in ("G05", "R10", "E04", "S23", "C14", "J01", "I02", *(f"G{j:02d}" for j in range(10, 18))):
            if rng.random() < 0.8:
                row = []
                for j, _ in enumerate(codes):
                    value[sv, j] = value.get((sv, j), rng.randrange(-10**6, 10**10)) + rng.randrange(-5000, 5000)
                    row.append((value[sv, j], rng.choice(" 01"), rng.choice("4567 ")) if rng.random() < 0.85 else None)
                sats[sv] = row
        out.append((k, sats))
    return codes, out


def head(version, k, n):
    return f" 24 01 02 00 {k:02d} 30.5000000  0{n:3d}" if version == 2 else f"> 2024 01 02 00 {k:02d} 30.5000000  0{n:3d}"


def expected(sats_by_epoch, codes):
    return {(k, sv, codes[j]): x for k, sats in sats_by_epoch for sv, row in sats.items() for j, x in enumerate(row) if x is not None}


def got(obs):
    return {(r["epoch_idx"], r["sv"], r["code"]): (r["value_e3"], r["lli"], r["ssi"]) for r in obs.collect()}


def plain(version, codes, data):
    lines = text.header_lines(version, codes, "GRESCJI")
    for k, sats in data:
        names = list(sats)
        if version == 3:
            lines.append(head(3, k, len(names)))
        else:
            lines.append(head(2, k, len(names)) + "".join(names[:12]))
            lines += [" " * 32 + "".join(names[i : i + 12]) for i in range(12, len(names), 12)]
        for sv, row in sats.items():
            cells = [" " * 16 if x is None else f"{('-' if x[0] < 0 else '') + str(abs(x[0]) // 1000) + '.' + str(abs(x[0]) % 1000).zfill(3):>14}{x[1]}{x[2]}" for x in row]
            if version == 3:
                lines.append((sv + "".join(cells)).rstrip())
            else:
                lines += ["".join(cells[i : i + 5]).rstrip() for i in range(0, len(cells), 5)]
    return "\n".join(lines) + "\n"


def compacted(version, codes, data, order=3):
    line = lambda body, name: f"{body:<60.60}{name:<20}"
    lines = [line(f"{'1.0' if version == 2 else '3.0':<20}COMPACT RINEX FORMAT", "CRINEX VERS   / TYPE"), line("x", "CRINEX PROG / DATE"), *text.header_lines(version, codes, "GRESCJI")]
    lines += compact.compact_text([(head(version, k, len(sats)), sats) for k, sats in data], version, order)
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("version", [2, 3])
def test_plain_and_compact_agree(spark, version):
    files, want = {}, {}
    for seed in range(2):
        codes, data = sample(seed, version)
        files |= {f"p{seed}": plain(version, codes, data), f"c{seed}": compacted(version, codes, data, 3 - seed)}
        want[f"p{seed}"] = want[f"c{seed}"] = expected(data, codes)
    out = reading(spark, files)
    for name, w in want.items():
        have = got(out.observations.where(F.col("file") == name))
        assert have == w
    assert out.parse_errors.count() == 0
    e = out.epochs.where("file = 'p0' and epoch_idx = 1").first()
    assert (e["date"], e["hh_mm"], e["sec_e7"], e["flag"]) == (20240102, 1, 305000000, "0")
    types = out.obs_types.where("file = 'p0'").collect()
    assert sorted((r["sys"], r["code_idx"], r["code"]) for r in types) == sorted((s, j, c) for s in (" " if version == 2 else "GRESCJI") for j, c in enumerate(codes))


def test_events_and_clock(spark):
    lines = [*text.header_lines(3, ("C1C",), "G"), "> 2024 01 01 00 00  0.0000000  0  1      -1.012345678901", "G01     20000.000", "> 2024 01 01 00 00  5.0000000  4  2", "a line", "another", "> 2024 01 01 00 00 60.0000000  6  1", "G01     20000.001"]
    out = reading(spark, {"f": "\n".join(lines) + "\n"})
    e = out.epochs.orderBy("epoch_idx").collect()
    assert [(r["rec_idx"], r["epoch_idx"], r["flag"], r["clock_offset_e12"]) for r in e] == [(0, 0, "0", -1012345678901), (2, 1, "6", None)]
    v = out.events.first()
    assert (v["rec_idx"], v["epoch_idx"], v["flag"], v["n_lines"]) == (1, 1, "4", 2) and v["text"].endswith("a line\nanother")


@pytest.mark.parametrize("content, reason", [("", "unrecognized file format"), ("x\n", "unrecognized file format"), ("\n".join(text.header_lines(3, ("C1C",), "G")[:-1]) + "\n", "version, type or end of header"), ("\n".join(x.replace("3.04", "1.00") for x in text.header_lines(3, ("C1C",), "G")) + "\n", "version, type or end of header")])
def test_unsupported(content, reason):
    rows = list(Framer("f", content).rows())
    assert rows[-1]["error"] == "UNSUPPORTED" and rows[-1]["reason"] == reason


def test_fail_fast(spark, tmp_path):
    (tmp_path / "a.24o").write_text("\n".join([*text.header_lines(2, ("C1",), "G"), " 24  1  x"]) + "\n")
    assert text.read_text(spark, str(tmp_path)).parse_errors.count() == 1
    with pytest.raises(ValueError):
        text.read_text(spark, str(tmp_path), mode="FAILFAST")


@given(st.lists(st.integers(-(2**40), 2**40), max_size=120), st.integers(0, 7))
@settings(max_examples=60, deadline=None)
def test_values_round_trip(values, order):
    data = codec.encode_values(np.array(values, np.int64), order)
    assert codec.decode_values(data, 0).tolist() == values


@given(st.lists(st.integers(-(2**40), 2**40), max_size=40), st.sampled_from([10, 500, 1000]))
@settings(max_examples=20, deadline=None)
def test_scaled_values(values, scale):
    values = [v * scale for v in values]
    assert codec.decode_values(codec.encode_values(np.array(values, np.int64), 2, scale), 0).tolist() == values


@pytest.mark.parametrize("count", [8, 16, 32])
def test_bit_matrix(count):
    rng = np.random.default_rng(1)
    for bits in range(1, 33):
        v = rng.integers(-(1 << (bits - 1)), 1 << (bits - 1), count)
        assert codec.transpose(codec.untranspose(v, bits), bits, count).tolist() == v.tolist()


@given(st.text(" 0123", max_size=60))
@settings(max_examples=40, deadline=None)
def test_indicators(chars):
    assert codec.decode_chars(codec.encode_chars(chars), 0, len(chars))[0] == chars


def test_integers_and_digests():
    for v in (0, 1, -1, 63, 64, -64, -65, 2**62, -(2**62)):
        assert codec.read_sleb(codec.sleb(v), 0)[0] == v
    assert codec.crc32c(b"123456789") == 0xE3069283
    assert [len(codec.digest(k, b"x")) for k in codec.DIGESTS] == list(codec.DIGESTS.values())
    assert codec.decode_presence(bytes([1, 2, 5, 4, 6]), 0) == [*range(2, 8), *range(13, 20)]  # the example in the format's definition
    with pytest.raises(ValueError):
        codec.unpack_blocks(bytes([0x70]), 0, 1)


def contents():
    head_text = "\n".join(text.header_lines(3, ("C1C", "L1C"), "GR")) + "\n"
    epochs = [(20240101, 2359, 595000000 + k * 1000000, 7 if k < 3 else 0) for k in range(5)] + [(20240102, 0, 0, 0), (20240102, 0, 300000000, 0), (20240102, 1, 0, 0), (20240102, 2, 0, 0)]
    c = codec.Contents(head_text, epochs, [(0, "first"), (3, "later\nlines")])
    c.satellites = {"G05": ([0, 1, 2, 5, 6], {"C1C": ([0, 1, 5], [10, -20, 30], "0 1", "567"), "L1C": ([2, 6], [5, 6], "  ", "99")}), "R10": ([4], {"L1C": ([4], [2**40], "3", " ")})}
    return c


@pytest.mark.parametrize("chunk, whole", [(0, 0), (2, 6), (20, 22)])
def test_store(chunk, whole):
    c = contents()
    data = codec.encode_file(c, chunk, whole)
    s = codec.Store(data)
    assert s.header == c.header and s.epochs() == c.epochs and s.events() == c.events
    sats = s.satellites()
    assert list(sats) == ["G05", "R10"]
    numbers, signals = s.satellite(sats["G05"])
    assert numbers == [0, 1, 2, 5, 6] and list(signals) == ["C1C", "L1C"]
    values, lli, ssi = s.signal(signals["C1C"])
    assert values.tolist() == [10, -20, 0, 30, 0] and lli == "0  1 " and ssi == "56 7 "
    s.directory = 0
    assert s.satellites() == sats
    if whole:
        broken = bytearray(data)
        broken[len(data) // 2] ^= 1
        with pytest.raises(ValueError):
            codec.Store(bytes(broken))


def test_store_reads_ranges(tmp_path):
    c = contents()
    c.satellites |= {f"E{k:02d}": ([0], {}) for k in range(1, 2)}
    rng = np.random.default_rng(1)
    c.satellites |= {f"G{k:02d}": (list(range(9)), {"C1C": (list(range(9)), rng.integers(0, 2**60, 9).tolist(), " " * 9, " " * 9)}) for k in range(30, 99)}
    c.events = [(0, "x" * 60_000)]
    path = tmp_path / "a.srnx"
    path.write_bytes(codec.encode_file(c, 2, 6))
    with path.open("rb") as f:
        data = codec.Ranged(f, path.stat().st_size)
        s = codec.Store(data)
        numbers, signals = s.satellite(s.satellites()["G05"])
        values, lli, ssi = s.signal(signals["C1C"])
        assert values.tolist() == [10, -20, 0, 30, 0] and lli == "0  1 " and numbers == [0, 1, 2, 5, 6]
        assert data.read_bytes < len(data) and s.epochs() == c.epochs and s.header == c.header
        assert s.events() == c.events


def test_framing_in_pieces():
    """Small pieces give what the whole text gives."""
    import io

    from skyledger.sources.framing import pieces_from

    for version in (2, 3):
        for put in (plain, compacted):
            codes, data = sample(5, version, 6)
            content = put(version, codes, data).replace("\n", "\r\n")
            whole = list(Framer("f", content).rows())
            for size in (7, 100, 5000):
                assert list(Framer("f", pieces_from(io.BytesIO(content.encode()), size)).rows()) == whole
            assert sum(r["kind"] == "obs" for r in whole) == 6


@pytest.mark.parametrize("letter, ok", [("M", True), ("G", True), (" ", True), ("R", False)])
def test_system_letter_of_version_2(spark, letter, ok):
    lines = text.header_lines(2, ("C1",), "G")
    lines[0] = lines[0][:40] + letter + lines[0][41:]
    out = reading(spark, {"f": "\n".join([*lines, " 24  1  1  0  0  3.0000000  0  1G01", "     20000.000"]) + "\n"})
    assert [r["sv"] for r in out.observations.collect()] == (["G01"] if ok else [])
    assert [r["reason"] for r in out.parse_errors.collect()] == ([] if ok else ["system without observation types"])


def test_clock_of_compact_files(spark):
    codes, data = sample(2, 3, 6)
    lines = compacted(3, codes, data).split("\n")
    end = next(i for i, x in enumerate(lines) if "END OF HEADER" in x)
    offsets = [5_000_000_000, -7, None, 12, 13, 15]
    body = compact.compact_text([(head(3, k, len(sats)), sats, c) for (k, sats), c in zip(data, offsets, strict=True)], 3, 2)
    out = reading(spark, {"c": "\n".join([*lines[: end + 1], *body]) + "\n"})
    assert [r["clock_offset_e12"] for r in out.epochs.orderBy("epoch_idx").collect()] == offsets
    assert got(out.observations) == expected(data, codes)


@pytest.mark.parametrize("field, value", [("     20000.000", 20000000), ("         -.120", -120), ("          .   ", 0), ("   4375274.   ", 4375274000), ("  4375274.    ", None), ("   437527 .000", None), ("   +437527.000", None), ("    437527.1 2", None), ("     43752.5  ", 43752500)])
def test_value_fields(spark, field, value):
    from skyledger.functions.fields import obs_value

    assert spark.createDataFrame([(field.ljust(16),)], "f string").select(obs_value(F.col("f")).alias("v")).first()["v"] == value


def test_store_source(spark, tmp_path):
    (tmp_path / "a.srnx").write_bytes(codec.encode_file(contents(), 2, 6))
    signal_store.register(spark)
    load = lambda **o: spark.read.format("signalstore").options(**o).load(str(tmp_path))
    rows = got(load())
    assert rows[5, "G05", "C1C"] == (30, "1", "7") and (2, "G05", "C1C") not in rows and len(rows) == 6
    assert got(load().where("sv = 'G05' and code in ('L1C')")).keys() == {(2, "G05", "L1C"), (6, "G05", "L1C")}
    assert load(table="epochs").count() == 9 and load(table="events").count() == 2 and load(table="headers").count() == 1
    assert sorted(r["sv"] for r in load(table="satellites").collect()) == ["G05", "R10"]
    assert signal_store.store_name("abcd0010.20o") == "abcd0010.srnx" and signal_store.store_name("x") == "x.srnx"
