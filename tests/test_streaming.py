"""Streams: passes, files in micro-batches, and per-signal decoding with state."""

from pyspark.sql import functions as F

from skyledger.sources import compact
from skyledger.streaming import passes as st
from tests.test_sources import compacted, expected, got, sample


def test_passes_stream_equals_batch(spark, tmp_path):
    rows = [("G01", f"2024-01-01 00:{m:02d}:00") for m in (0, 10, 20, 55)] + [("R02", "2024-01-01 00:05:00"), ("G01", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "sv string, ts string").select("sv", F.to_timestamp("ts").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = st.passes(stream).writeStream.format("memory").queryName("passes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {tuple(r) for r in st.passes(df).collect()}
    streamed = {tuple(r) for r in spark.table("passes").collect()}
    assert len(batch) == 4 and streamed <= batch and len(streamed) >= 3  # the last pass is still open


def test_files_in_batches(spark, tmp_path):
    folder, seen = tmp_path / "files", {}
    folder.mkdir()
    want = {}
    for seed in range(3):
        codes, data = sample(seed, 3, 5)
        (folder / f"f{seed}.24d").write_text(compacted(3, codes, data))
        want[f"f{seed}.24d"] = expected(data, codes)

    def use(reading, n):
        for name in want:
            part = got(reading.observations.where(F.col("file").endswith(name)))
            if part:
                seen[name] = part

    st.for_each_file_batch(st.stream_files(spark, str(folder), 2), use, str(tmp_path / "check")).awaitTermination(120)
    assert seen == want


def test_stateful_decoding(spark, tmp_path):
    values = [("f", "G01", "C1C", k, v) for k, v in enumerate([100, 103, 109, 120, 140, 141, 150])]
    df = spark.createDataFrame(values, "file string, sv string, code string, epoch_idx bigint, value_e3 bigint")
    items = compact.encode_items(df, ["file", "sv", "code"], "epoch_idx", "value_e3", 2)
    token = F.when(F.col("k") == 0, F.concat(F.col("n").cast("string"), F.lit("&"), F.col("item").cast("string"))).otherwise(F.col("item").cast("string"))
    rows = items.select("file", "sv", "code", "epoch_idx", token.alias("token"))
    for part, cond in enumerate(("epoch_idx < 3", "epoch_idx >= 3")):
        rows.where(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = st.decode_stream(stream).writeStream.format("memory").queryName("decoded").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["epoch_idx"], r["value_e3"]) for r in spark.table("decoded").collect()) == [(x[3], x[4]) for x in values]
