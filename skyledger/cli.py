"""Command line: python -m skyledger.cli scan|maxima|counts|analyze|pack|unpack [-v] [--out DIR] FILE...

The first four print CSV for files, folders or globs; `-` reads one file from standard input. pack
writes binary stores to the folder --out, unpack writes their text.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators import analytics as an
from skyledger.session import local_session
from skyledger.sources import convert, text
from skyledger.sources import scan as scanning


def scan(got: scanning.Scan, verbose: bool) -> list[DataFrame]:
    blank = got.obs_types.where("sys = ' '").groupBy("file").agg(F.count("*").alias("sysobs"))
    usual = got.epochs.where(F.col("flag").isin("0", "1")).select("file", "epoch_idx")
    words = got.words.join(usual, ["file", "epoch_idx"], "left_semi")
    every = got.epochs.select("file").unionAll(got.events.select("file"))
    out = got.headers.select("file").distinct().join(an.word_summary(words, every).drop("sysobs"), "file", "left").join(blank, "file", "left")
    numbers = ["epochs", "maxobs", "maxsats", "sysobs", "satobs", "totobs", "maxepochs"]  # a file without a record has its line, too
    out = out.select(F.col("file").alias("filename"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers])
    detail = got.epochs.select("file", "epoch_idx", "date", "hh_mm", "sec_e7").join(an.word_epoch_counts(words), ["file", "epoch_idx"]).orderBy("file", "epoch_idx")
    return [detail, out] if verbose else [out]


def maxima(got: scanning.Scan, verbose: bool) -> list[DataFrame]:
    usual = got.epochs.where(F.col("flag").isin("0", "1")).select("file", "epoch_idx")
    obs = got.words.withColumn("sys", F.substring("sv", 1, 1)).join(usual, ["file", "epoch_idx"], "left_semi")
    out = an.constellation_maxima(obs)
    return [an.running_maxima(obs).orderBy("file", "sys", "epoch_idx"), out] if verbose else [out]


def counts(got: text.Reading, verbose: bool) -> list[DataFrame]:
    return [an.code_count_maxima(got.obs_types).orderBy("key"), an.code_count_histogram(got.obs_types).orderBy("n")]


def analyze(got: text.Reading, verbose: bool) -> list[DataFrame]:
    heads = got.headers.groupBy("file").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.rtrim(x["line"]))).alias("text"))
    total = an.compression_total(got.observations, heads, got.events)
    return [an.delta_costs(got.observations).orderBy("file", "sv", "code"), total, an.zero_ranges(got.observations).orderBy("level"), an.sign_bit_histogram(got.observations).orderBy("level", "bits")]


COMMANDS = {"scan": scan, "maxima": maxima, "counts": counts, "analyze": analyze}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="skyledger")
    p.add_argument("command", choices=[*COMMANDS, "pack", "unpack"])
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--out", help="folder for CSV parts instead of standard output")
    p.add_argument("files", nargs="+")
    a = p.parse_args(args)
    spark = local_session()
    if a.command == "unpack":
        text.write_text(convert.unpack(spark, a.files[0]), a.out)
        return 0
    read = scanning.scan_text if a.command in ("scan", "maxima", "counts") else text.read_text  # the others need values
    got = read(spark, *([text.spool(spark)] if a.files == ["-"] else a.files))
    if a.command == "pack":
        print(convert.pack(got, a.out))
    for k, df in enumerate([] if a.command == "pack" else COMMANDS[a.command](got, a.verbose)):
        if a.out:
            df.write.mode("overwrite").option("header", True).csv(f"{a.out}/{a.command}-{k}")
        else:
            print(",".join(df.columns))
            for row in df.toLocalIterator():
                print(",".join("" if x is None else str(x) for x in row))
    bad = got.parse_errors.orderBy("file", "line_no")
    for r in bad.toLocalIterator():
        print(f"{r['file']}:{r['line_no']}: {r['error']} ({r['reason']})", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
