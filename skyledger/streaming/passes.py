"""Satellite passes and per-signal decoding over streams; the same functions take batch input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def passes(obs: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(sv, start, end, n): sessions of obs(sv, ts timestamp) that a gap ends; end is the last plus the gap."""
    rows = obs.withWatermark("ts", late) if obs.isStreaming else obs
    out = rows.groupBy("sv", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("sv", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_files(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """(file, content) of files that appear in a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.select(F.col("path").alias("file"), F.col("content").cast("string").alias("content"))


def for_each_file_batch(files: DataFrame, use: Callable, checkpoint: str, once: bool = True):
    """Frames and parses each micro-batch of files and hands use(reading, batch number) the tables."""
    from skyledger.sources.text import Reading, records

    def batch(df: DataFrame, n: int) -> None:
        use(Reading(records(df)), n)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


DECODED = "file string, sv string, code string, epoch_idx bigint, value_e3 bigint"


def decode_stream(items: DataFrame) -> DataFrame:
    """Undoes differences of a stream items(file, sv, code, epoch_idx, token) by signal; tokens as in
    compact files: `N&v`, a number, or null. Rows of a signal must come in the order of their epochs
    from batch to batch; within a batch they are sorted. State by signal: order and current levels."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        order, levels = (state.get[0], list(state.get[1])) if state.exists else (-1, [])
        rows, out = pd.concat(parts).sort_values("epoch_idx"), []
        for epoch, token in zip(rows["epoch_idx"], rows["token"], strict=True):
            if not isinstance(token, str) or token == "":
                order, levels = -1, []
                continue
            if token[1:2] == "&":
                order, levels = int(token[0]), [int(token[2:])]
            elif order >= 0:
                d = int(token)
                if len(levels) <= order:
                    levels.append(d)
                else:
                    levels[order] = d
                for j in range(len(levels) - 2, -1, -1):
                    levels[j] += levels[j + 1]
            else:
                continue
            out.append((*key, int(epoch), levels[0]))
        state.update((order, levels))
        yield pd.DataFrame(out, columns=["file", "sv", "code", "epoch_idx", "value_e3"])

    return items.groupBy("file", "sv", "code").applyInPandasWithState(step, DECODED, "n int, levels array<bigint>", "append", "NoTimeout")
