"""Folds over observations: scan summaries, maxima, presence runs, difference and run-length costs.

Inputs follow the canonical schema: observations(file, epoch_idx, sys, prn, sv, code_idx, code,
value_e3, lli, ssi). All are keyed by file; windows are by signal (file, sv, code) or satellite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.functions.fields import differences, sign_bits, sleb_length, uleb_length

SIGNAL = ["file", "sv", "code"]


def is_present() -> Column:
    return F.col("value_e3").isNotNull() & (F.col("value_e3") != 0)


def signal_window() -> W:
    return W.partitionBy(*SIGNAL).orderBy("epoch_idx")


def by_word(obs: DataFrame) -> DataFrame:
    """(file, epoch_idx, sv, word, n, mask): observations that are present, counted and as bits of their
    codes, 63 to a word; so codes may have any index."""
    bit = F.when(is_present(), F.expr("shiftleft(1L, code_idx % 63)"))
    rows = obs.withColumn("word", F.floor(F.col("code_idx") / 63).cast("int"))
    return rows.groupBy("file", "epoch_idx", "sv", "word").agg(F.count(F.when(is_present(), 1)).alias("n"), F.coalesce(F.bit_or(bit), F.lit(0)).cast("bigint").alias("mask"))


def epoch_counts(obs: DataFrame) -> DataFrame:
    """(file, epoch_idx, n_sats, n_obs): satellites in the epoch, and observations that are present."""
    return word_epoch_counts(by_word(obs))


def word_epoch_counts(words: DataFrame) -> DataFrame:
    by_sat = words.groupBy("file", "epoch_idx", "sv").agg(F.sum("n").alias("n"))
    return by_sat.groupBy("file", "epoch_idx").agg(F.count("*").alias("n_sats"), F.sum("n").alias("n_obs"))


def scan_summary(obs: DataFrame, epochs: DataFrame | None = None, sysobs: Column | None = None) -> DataFrame:
    """A row a file. epochs(file): every record, for files with records that hold no observation.

    Epochs, satellites and codes are all summed up from the same rows by satellite, epoch and word of codes.
    """
    return word_summary(by_word(obs), epochs, sysobs)


def word_summary(base: DataFrame, epochs: DataFrame | None = None, sysobs: Column | None = None) -> DataFrame:
    """The same from (file, epoch_idx, sv, word, n, mask)."""
    by_sv = base.groupBy("file", "epoch_idx", "sv").agg(F.sum("n").alias("n"))
    by_epoch = by_sv.groupBy("file", "epoch_idx").agg(F.count("*").alias("n_sats"), F.sum("n").alias("n_obs"))
    seen = by_epoch.groupBy("file").agg(F.count("*").alias("n"), F.max("n_obs").alias("maxobs"), F.max("n_sats").alias("maxsats"), F.sum("n_obs").alias("totobs"))
    longest = by_sv.groupBy("file", "sv").agg(F.count("*").alias("epochs")).groupBy("file").agg(F.max("epochs").alias("maxepochs"))
    codes = base.groupBy("file", "sv", "word").agg(F.bit_or("mask").alias("mask")).groupBy("file").agg(F.sum(F.bit_count("mask")).cast("bigint").alias("satobs"))
    out = seen.join(longest, "file").join(codes, "file")
    out = out.withColumn("epochs", F.col("n")) if epochs is None else epochs.groupBy("file").agg(F.count("*").alias("epochs")).join(out, "file", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("file", "epochs", number("maxobs"), number("maxsats"), (sysobs if sysobs is not None else F.lit(0)).alias("sysobs"), *map(number, ("satobs", "totobs", "maxepochs")))


def satellites_by_system(obs: DataFrame) -> DataFrame:
    return obs.groupBy("file", "epoch_idx", "sys", "sv").agg(F.lit(1).alias("one")).groupBy("file", "epoch_idx", "sys").agg(F.count("*").alias("n_sats"))


def constellation_maxima(obs: DataFrame, systems: tuple[str, ...] = ("G", "E", "R", "C")) -> DataFrame:
    n = satellites_by_system(obs)
    columns = [F.coalesce(F.max(F.when(F.col("sys") == s, F.col("n_sats"))), F.lit(0)).alias(s) for s in systems]
    by_epoch = n.groupBy("file", "epoch_idx").agg(F.sum("n_sats").alias("sats"), *columns)
    return by_epoch.groupBy("file").agg(F.count("*").alias("count"), F.max("sats").alias("max_sats"), *[F.max(s).alias(s) for s in systems])


def running_maxima(obs: DataFrame) -> DataFrame:
    """The epochs at which a system's satellite count passes all counts before."""
    w = W.partitionBy("file", "sys").orderBy("epoch_idx").rowsBetween(W.unboundedPreceding, -1)
    n = satellites_by_system(obs).withColumn("before", F.coalesce(F.max("n_sats").over(w), F.lit(0)))
    return n.where("n_sats > before").select("file", "sys", "epoch_idx", "n_sats")


def code_count_maxima(obs_types: DataFrame) -> DataFrame:
    """By system, or `2` for files of version 2: the most codes of any file."""
    key = F.when(F.col("version").startswith("2"), "2").otherwise(F.col("sys"))
    return obs_types.groupBy("file", key.alias("key")).agg(F.countDistinct("code").alias("n")).groupBy("key").agg(F.max("n").alias("max_codes"))


def code_count_histogram(obs_types: DataFrame, bins: int = 128) -> DataFrame:
    counts = obs_types.groupBy("file", "sys").agg(F.countDistinct("code").alias("n"))
    found = counts.groupBy(F.least("n", F.lit(bins)).alias("n")).agg(F.count("*").alias("files"))
    every = obs_types.sparkSession.range(bins).withColumnRenamed("id", "n")
    return every.join(F.broadcast(found), "n", "left").select("n", F.coalesce("files", F.lit(0)).alias("files"))  # found has bins rows at most


def presence_masks(obs: DataFrame) -> DataFrame:
    """(file, sv, word, mask, n_codes): codes ever present by satellite, as bits, 63 to a word."""
    return by_word(obs).groupBy("file", "sv", "word").agg(F.bit_or("mask").alias("mask")).withColumn("n_codes", F.bit_count("mask"))


def presence_runs(obs: DataFrame) -> DataFrame:
    """Runs of consecutive epochs in which a satellite is present: (file, sv, run_idx, start, count)."""
    seen = obs.select("file", "sv", "epoch_idx").distinct()
    w = W.partitionBy("file", "sv").orderBy("epoch_idx")
    runs = seen.withColumn("island", F.col("epoch_idx") - F.row_number().over(w)).groupBy("file", "sv", "island").agg(F.min("epoch_idx").alias("start"), F.count("*").alias("count"))
    return runs.select("file", "sv", (F.row_number().over(W.partitionBy("file", "sv").orderBy("start")) - 1).alias("run_idx"), "start", "count")


def expand_runs(runs: DataFrame) -> DataFrame:
    return runs.select("file", "sv", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("epoch_idx"))


def difference_orders(obs: DataFrame, orders: int = 5) -> DataFrame:
    """Adds ord, the item's number in its signal, and d1..dN, null where there are too few items."""
    w = signal_window()
    out = obs.withColumn("ord", F.row_number().over(w) - 1)
    return out.withColumns({f"d{n}": d for n, d in enumerate(differences(F.col("value_e3"), w, orders), 1)})


def delta_costs(obs: DataFrame, orders: int = 5) -> DataFrame:
    """Bytes of each signal's values as differences of order 0..N: item k is stored with order min(k, n)."""
    d = difference_orders(obs, orders)
    item = lambda n: F.coalesce(*[F.col(f"d{k}") for k in range(n, 0, -1)], F.col("value_e3"))
    sums = [F.sum(sleb_length(item(n))).cast("bigint").alias(f"l{n}") for n in range(orders + 1)]
    return d.groupBy(*SIGNAL).agg(*sums, F.count("*").alias("n")).withColumn("best", F.least(*[F.col(f"l{n}") for n in range(orders + 1)]))


def by_level(obs: DataFrame, orders: int = 5) -> DataFrame:
    d = difference_orders(obs, orders)
    return d.select(F.posexplode(F.array(*[F.col(f"d{n}") for n in range(1, orders + 1)])).alias("level", "d")).where("d is not null").withColumn("level", F.col("level") + 1)


def zero_ranges(obs: DataFrame) -> DataFrame:
    """Least and largest difference by order over all signals; 0 is always within."""
    return by_level(obs).groupBy("level").agg(F.least(F.lit(0), F.min("d")).alias("lo"), F.greatest(F.lit(0), F.max("d")).alias("hi"))


def sign_bit_histogram(obs: DataFrame) -> DataFrame:
    return by_level(obs).groupBy("level", sign_bits(F.col("d")).alias("bits")).agg(F.count("*").alias("n"))


def run_lengths(obs: DataFrame, column: str) -> DataFrame:
    """Runs of equal values along a signal: (file, sv, code, run, value, start, len), start as item number."""
    w = signal_window()
    rows = obs.select(*SIGNAL, "epoch_idx", F.col(column).alias("value")).withColumn("ord", F.row_number().over(w) - 1)
    new = F.when(F.col("value").eqNullSafe(F.lag("value").over(w)) & (F.col("ord") > 0), 0).otherwise(1)
    runs = rows.withColumn("run", F.sum(new).over(w))
    return runs.groupBy(*SIGNAL, "run").agg(F.first("value").alias("value"), F.min("ord").alias("start"), F.count("*").alias("len"))


def run_length_costs(obs: DataFrame, column: str, name: str) -> DataFrame:
    return run_lengths(obs, column).groupBy(*SIGNAL).agg(F.sum(1 + uleb_length(F.col("len") - 1)).cast("bigint").alias(name))


def compression_total(obs: DataFrame, headers: DataFrame | None = None, special: DataFrame | None = None) -> DataFrame:
    """Bytes of a file in the binary layout, a row a file.

    headers(file, text) and special(file, epoch_idx, text) add what they hold.
    """
    signals = delta_costs(obs).join(run_length_costs(obs, "lli", "lli_cost"), SIGNAL).join(run_length_costs(obs, "ssi", "ssi_cost"), SIGNAL)
    signals = signals.groupBy("file").agg(F.count("*").alias("n_signals"), F.sum(F.col("lli_cost") + F.col("ssi_cost") + 1 + F.col("best")).cast("bigint").alias("signal_bytes"))
    w = W.partitionBy("file", "sv").orderBy("start")
    runs = presence_runs(obs).withColumn("gap", F.col("start") - F.coalesce(F.lag(F.col("start") + F.col("count")).over(w), F.lit(0)))
    runs = runs.groupBy("file").agg(F.sum(uleb_length(F.col("gap")) + uleb_length(F.col("count") - 1)).cast("bigint").alias("run_bytes"))
    epochs = obs.select("file", "epoch_idx").distinct().groupBy("file").agg(F.count("*").alias("n_epochs"))
    out = epochs.join(signals, "file").join(runs, "file")
    for rows, name, cost in ((headers, "header_bytes", F.octet_length("text")), (special, "event_bytes", F.octet_length("text") + (uleb_length(F.col("epoch_idx")) if special is not None else F.lit(0)))):
        if rows is None:
            out = out.withColumn(name, F.lit(0).cast("bigint"))
        else:
            out = out.join(rows.groupBy("file").agg(F.sum(cost).cast("bigint").alias(name)), "file", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    parts = ["header_bytes", "event_bytes", "run_bytes", "signal_bytes"]
    return out.select("file", "n_epochs", "n_signals", *parts, sum(F.col(c) for c in parts).alias("total_bytes"))


def epoch_spans(epochs: DataFrame) -> DataFrame:
    """Spans of epochs at a common interval: (file, start, interval, count); a lone epoch has interval 0.

    epochs(file, t) with t a number. A span begins at the first epoch and wherever the step changes.
    """
    w = W.partitionBy("file").orderBy("t")
    step = epochs.withColumn("step", F.col("t") - F.lag("t").over(w))
    new = F.when(F.col("step").eqNullSafe(F.lag("step").over(w)) | F.lag("step").over(w).isNull() & F.lag("t").over(w).isNotNull(), 0).otherwise(1)
    spans = step.withColumn("span", F.sum(new).over(w))
    return spans.groupBy("file", "span").agg(F.min("t").alias("start"), (F.max("t") - F.min("t")).alias("reach"), F.count("*").alias("count")).select("file", "start", F.when(F.col("count") > 1, F.expr("reach div (count - 1)")).otherwise(0).alias("interval"), "count")


def expand_spans(spans: DataFrame) -> DataFrame:
    return spans.select("file", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1), lambda k: F.col("start") + k * F.col("interval"))).alias("t"))


def before_epoch(special: DataFrame, epochs: DataFrame) -> DataFrame:
    """Each special event with the first epoch not before it: special(file, at, ...) and epochs(file, epoch_idx).

    Distinct moments meet epochs in one window a file; rows then take their moment's answer by an equi-join.
    """
    moments = special.select("file", F.col("at")).distinct().withColumn("epoch", F.lit(None).cast("bigint"))
    marks = moments.unionByName(epochs.select("file", F.col("epoch_idx").alias("at"), F.col("epoch_idx").alias("epoch")).distinct())
    w = W.partitionBy("file").orderBy(F.col("at").desc(), F.col("epoch").desc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    found = marks.withColumn("before_epoch", F.min("epoch").over(w)).where("epoch is null").select("file", "at", "before_epoch")
    return special.join(found, ["file", "at"], "left")


def satellite_order(obs: DataFrame) -> DataFrame:
    """Place of each satellite in its epoch and in the epoch before, -1 if it is new."""
    seen = obs.select("file", "epoch_idx", "sv").distinct()
    now = seen.withColumn("sv_pos", F.row_number().over(W.partitionBy("file", "epoch_idx").orderBy("sv")) - 1)
    last = now.select("file", (F.col("epoch_idx") + 1).alias("epoch_idx"), "sv", F.col("sv_pos").alias("prev_pos"))
    return now.join(last, ["file", "epoch_idx", "sv"], "left").withColumn("prev_pos", F.coalesce("prev_pos", F.lit(-1)))


def unknown_codes(obs_types: DataFrame, wanted: list[str]) -> DataFrame:
    """Wanted codes that a system of a file does not have."""
    systems = obs_types.select("file", "sys").distinct()
    asked = systems.select("file", "sys", F.explode(F.array(*map(F.lit, wanted))).alias("code"))
    return asked.join(obs_types, ["file", "sys", "code"], "left_anti")


def select_signals(obs: DataFrame, svs: list[str], codes: list[str]) -> DataFrame:
    return obs.where(F.col("sv").isin(svs) & F.col("code").isin(codes))


def signal_arrays(obs: DataFrame) -> DataFrame:
    """A row a signal with its values and indicators as arrays in epoch order."""
    rows = F.array_sort(F.collect_list(F.struct("epoch_idx", "value_e3", "lli", "ssi")))
    return obs.groupBy(*SIGNAL).agg(rows.alias("rows")).select(*SIGNAL, F.col("rows.epoch_idx").alias("epochs"), F.col("rows.value_e3").alias("values"), F.col("rows.lli").alias("lli"), F.col("rows.ssi").alias("ssi"))


def used_versus_expected(obs: DataFrame, counts: DataFrame) -> DataFrame:
    """Signals whose number of values differs from counts(file, sv, code, expected)."""
    used = obs.groupBy(*SIGNAL).agg(F.count(F.when(is_present(), 1)).alias("used"))
    return counts.join(used, SIGNAL, "left").withColumn("used", F.coalesce("used", F.lit(0))).where("used <> expected")


def per_file(rows: DataFrame, use, schema: str) -> DataFrame:
    """use(pandas frame of a file's rows, in the order of epochs) -> pandas frame: for folds that no
    expression says. A file's rows are one task's."""
    return rows.groupBy("file").applyInPandas(lambda part: use(part.sort_values([c for c in ("epoch_idx", "sv", "code_idx") if c in part])), schema)
