"""Stores are encoded a satellite at a time, however many files a batch has."""

import pyarrow as pa

from skyledger.sources import signal_store
from skyledger.sources.codec import Store
from tests.test_memory import peak

STRUCTS = pa.list_(pa.struct([("epoch_idx", pa.int64()), ("value_e3", pa.int64()), ("lli", pa.string()), ("ssi", pa.string())]))
TIMES = pa.list_(pa.struct([("epoch_idx", pa.int64()), ("date", pa.int32()), ("hh_mm", pa.int32()), ("sec_e7", pa.int32()), ("clock", pa.int64())]))
STORE = pa.schema([("file", pa.string()), ("kind", pa.int32()), ("text", pa.string()), ("epochs", TIMES), ("epoch_idx", pa.int64()), ("sv", pa.string()), ("code", pa.string()), ("v", STRUCTS)])


def signals(n_files):
    rows = []
    for k in range(n_files):
        rows.append({"file": f"f{k:03d}", "kind": signal_store.HEAD, "text": "".join(f"{x:<60}{y:<20}\n" for x, y in (("     3.04           OBSERVATION DATA    M", "RINEX VERSION / TYPE"), ("G    2 C1C L1C", "SYS / # / OBS TYPES"))), "epochs": [{"epoch_idx": i, "date": 20240101, "hh_mm": i % 60, "sec_e7": 0, "clock": None} for i in range(60)]})
        rows += [{"file": f"f{k:03d}", "kind": signal_store.EVENT, "text": f"note {i}", "epoch_idx": i} for i in range(3)]
        rows += [{"file": f"f{k:03d}", "kind": signal_store.SIGNAL, "sv": f"G{p:02d}", "code": c, "v": [{"epoch_idx": i, "value_e3": 7 * i + p, "lli": None, "ssi": "5"} for i in range(p % 3, 60)]} for p in range(1, 33) for c in ("C1C", "L1C")]
    return pa.RecordBatch.from_pylist(rows, schema=STORE)


def test_stores_are_encoded_a_satellite_at_a_time():
    one, many = (peak([signals(n)], lambda x: signal_store.encoded(x, 0, 0)) for n in (1, 12))
    assert many < one + 1  # all files of a batch as dicts: 12 times as much


def test_stores_of_a_batch_cut_anywhere():
    whole = signals(3)
    for size in (1, 7, 1000):
        out = pa.Table.from_batches(list(signal_store.encoded([whole.slice(k, size) for k in range(0, whole.num_rows, size)], 2, 6))).to_pylist()
        assert [r["file"] for r in out] == ["f000", "f001", "f002"]
        for r in out:
            s = Store(r["content"])
            assert len(s.epochs()) == 60 and s.events() == [(i, f"note {i}") for i in range(3)] and len(s.satellites()) == 32
            numbers, at = s.satellite(s.satellites()["G05"])
            values, _, ssi = s.signal(at["L1C"])
            assert numbers == list(range(2, 60)) and values.tolist() == [7 * i + 5 for i in numbers] and ssi == "5" * 58
