"""Steps in Python over files hold a small part of them, however many files and rows a batch has."""

import tracemalloc

import pyarrow as pa

from skyledger.plans import station
from skyledger.sources import arrow

SVS = [f"{s}{k:02d}" for s in "CEGRS" for k in range(1, 40)]


def peak(batches, run):
    """MB of Python objects at most, over a run that keeps nothing."""
    tracemalloc.start()
    for _ in run(batches):
        pass
    out = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out


def hours(n, file="d1"):
    rows = [{"file": file, "hour": h, "flag": "0", "sv": sv, "code_idx": c, "value_e3": 1000 * h + c, "lli": "1", "ssi": "5"} for h in range(n) for sv in SVS for c in range(5)]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.int64() if c in ("hour", "event_id", "clock", "value_e3") else pa.int32() if c == "code_idx" else pa.string()) for c in station.ROW]))


def test_station_files_hold_an_hour():
    for version, packed in ((2, False), (3, True)):
        # a dict of each row would be some 20 MB
        assert peak([hours(48)], lambda x: station.put_files(x, version, packed)) < 8


def test_contents_are_taken_out_one_by_one():
    batch = pa.record_batch({"file": [f"f{k}" for k in range(20)], "content": ["x" * 1_000_000] * 20})
    assert peak([batch], arrow.files_of) < 5  # all at once: 20
