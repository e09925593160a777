"""Compact (difference-coded) observation text: decoding with windows, and encoding.

An arc `N&v` starts a value's differences of order N; item k of the arc is its min(k, N)-th
difference. Undoing them takes N running sums over the arc, all in one partitioning and order.
Indicator characters are filled forward: blank keeps, & clears. State is by satellite, and a
satellite that was absent, or an initial epoch line, starts anew.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.functions.fields import crx_int, crx_kind, parse_uint

MAX_ORDER = 9


def undo_differences(rows: DataFrame, keys: list[str], order_by: str, item: str, order: str, k: str, max_order: int = MAX_ORDER) -> DataFrame:
    """Adds `value`: keys name an arc, item its stored numbers, order its N, k the item's number."""
    w = W.partitionBy(*keys).orderBy(order_by).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("value", F.col(item))
    for j in range(max_order - 1, -1, -1):
        u = F.when(F.col(k) == j, F.col(item)).when(F.col(k) > j, F.col("value")).otherwise(0)
        rows = rows.withColumn("value", F.when(F.col(order) <= j, F.col("value")).otherwise(F.sum(u).over(w)))
    return rows


def fill_flags(init: Column, char: Column, window) -> Column:
    """The indicator in force: char is null or blank where nothing is said."""
    c = F.coalesce(char, F.lit(" "))
    said = F.when(c == "&", " ").when((c != " ") | init, c)
    return F.last(said, ignorenulls=True).over(window)


def decode_compact(recs: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """Observations of compact records. max_order: the highest order in use; the format knows 9."""
    rows = recs.where((F.col("kind") == "obs") & F.col("compact")).select("file", "version", "epoch_idx", "init", "codes", F.posexplode("lines").alias("sv_pos", "line"))
    system, prn = F.substring("line", 1, 1), parse_uint(F.substring("line", 2, 2))
    rows = rows.withColumns({"sys": system, "prn": prn, "text": F.substr("line", F.lit(4))}).withColumn("sv", F.concat("sys", F.lpad(F.col("prn").cast("string"), 2, "0")))
    # passes: stretches in which a satellite is in every epoch, none of them initial but the first
    w = W.partitionBy("file", "sv").orderBy("epoch_idx")
    fresh = F.col("init") | (F.lag("epoch_idx").over(w) + 1 != F.col("epoch_idx")) | F.lag("epoch_idx").over(w).isNull()
    rows = rows.withColumn("fresh", fresh).withColumn("pass", F.sum(F.col("fresh").cast("int")).over(w))
    names = F.split(F.element_at(F.str_to_map("codes", F.lit(";"), F.lit(":")), F.when(F.col("version") == "2", " ").otherwise(F.col("sys"))), ",")
    n = F.size("names")
    tokens = F.split("text", " ")  # n values, each followed by a blank; the rest are indicators, blanks included
    flags = F.array_join(F.slice("tokens", n + 1, F.greatest(F.size("tokens") - n, F.lit(0))), " ")
    rows = rows.withColumns({"names": names, "tokens": tokens}).withColumn("flags", flags)
    items = F.transform("names", lambda c, j: F.struct(j.alias("code_idx"), c.alias("code"), F.get("tokens", j).alias("token"), F.substring(F.col("flags"), 2 * j + 1, F.lit(1)).alias("l"), F.substring(F.col("flags"), 2 * j + 2, F.lit(1)).alias("s")))
    long = rows.select("file", "epoch_idx", "sv_pos", "sys", "prn", "sv", "fresh", "pass", F.explode(items).alias("x")).select("*", "x.*").drop("x").where("code <> ''")
    signal = W.partitionBy("file", "sv", "pass", "code_idx").orderBy("epoch_idx")
    l, s = (F.nullif(F.col(c), F.lit("")) for c in ("l", "s"))
    long = long.withColumns({"lli": fill_flags(F.col("fresh"), l, signal), "ssi": fill_flags(F.col("fresh"), s, signal)})
    return undo_arcs(long, ["file", "sv", "pass", "code_idx"], "token", max_order).withColumn("value_e3", F.col("value"))


def undo_arcs(rows: DataFrame, keys: list[str], token: str, max_order: int = MAX_ORDER) -> DataFrame:
    """Adds `value`, for the rows that have one: keys name a sequence by epoch_idx, token its fields. An
    arc runs from its start to the next start, gap or bad field."""
    sequence = W.partitionBy(*keys).orderBy("epoch_idx")
    rows = rows.withColumn("what", crx_kind(F.col(token)))
    rows = rows.withColumn("arc", F.sum(F.when(F.col("what") == "delta", 0).otherwise(1)).over(sequence))
    within = W.partitionBy(*keys, "arc").orderBy("epoch_idx")
    rows = rows.withColumns({
        "n": F.first(F.when(F.col("what") == "start", F.substring(token, 1, 1).try_cast("int"))).over(within),
        "k": F.row_number().over(within) - 1,
        "item": F.when(F.col("what") == "start", crx_int(F.substr(token, F.lit(3)))).otherwise(crx_int(F.col(token))),
    }).where("n is not null and item is not null")
    return undo_differences(rows, [*keys, "arc"], "epoch_idx", "item", "n", "k", max_order)


def decode_clock(epochs: DataFrame) -> DataFrame:
    """Adds clock_offset_e12 to compact epochs(file, version, epoch_idx, init, clock, …): the clock line
    is an arc by file; version 2 has nine decimals. Windows hold a row an epoch."""
    init = F.sum(F.col("init").cast("int")).over(W.partitionBy("file").orderBy("epoch_idx"))
    found = undo_arcs(epochs.select("file", "epoch_idx", "clock", init.alias("pass")), ["file", "pass"], "clock")
    value = F.col("value") * F.when(F.col("version") == "2", 1000).otherwise(1)
    return epochs.join(found.select("file", "epoch_idx", "value"), ["file", "epoch_idx"], "left").withColumn("clock_offset_e12", value).drop("value")


def encode_items(obs: DataFrame, keys: list[str], order_by: str, value: str, order: int) -> DataFrame:
    """Adds item, k and n: one arc for each key, in differences of the given order."""
    from skyledger.functions.fields import differences

    w = W.partitionBy(*keys).orderBy(order_by)
    out = obs.withColumns({"k": F.row_number().over(w) - 1, "n": F.lit(order), **{f"_d{i}": d for i, d in enumerate(differences(F.col(value), w, order), 1)}})
    item = F.coalesce(*[F.col(f"_d{i}") for i in range(order, 0, -1)], F.col(value))
    return out.withColumn("item", item).drop(*[f"_d{i}" for i in range(1, order + 1)])


class Arc:
    """Turns the numbers of one sequence into tokens."""

    def __init__(self, order: int):
        self.order, self.levels = order, None

    def token(self, value: int | None) -> str:
        if value is None:
            self.levels = None
            return ""
        if self.levels is None:
            self.levels = [value]
            return f"{self.order}&{value}"
        levels = [value]
        for before in self.levels[: self.order]:
            levels.append(levels[-1] - before)
        self.levels = levels
        return str(levels[-1])


def changes(old: str, new: str) -> str:
    """Blank where nothing changes, & where a blank comes, else the new character."""
    size = max(len(old), len(new))
    return "".join(" " if a == b else "&" if b == " " else b for a, b in zip(old.ljust(size), new.ljust(size), strict=True))


def compact_text(epochs: list[tuple], version: int, order: int = 3) -> list[str]:
    return list(compact_lines(epochs, version, order))


def compact_lines(epochs: Iterable[tuple], version: int, order: int = 3) -> Iterator[str]:
    """Compact lines of epochs, in Python, for writing files and for tests. An epoch is (epoch line
    without satellites, {sv: fields}), with a third item for the clock offset as a whole number or
    None; a field is (value_e3, lli, ssi) or None. An event is (event line, list of its lines): it is
    written as it is, and the next epoch begins anew."""
    last_line, arcs, flags, clock = None, {}, {}, Arc(order)
    for head, sats, *more in epochs:
        if isinstance(sats, list):
            yield from ["&" + head[1:] if version == 2 else head, *sats]
            last_line = None
            continue
        full = head.ljust(32 if version == 2 else 41) + "".join(sats)
        if last_line is None:
            yield "&" + full[1:] if version == 2 else full
            arcs, flags, clock = {}, {}, Arc(order)
        else:
            yield changes(last_line, full).rstrip()
        last_line = full
        yield clock.token(more[0] if more else None)
        arcs, flags = {sv: arcs.get(sv) or [Arc(order) for _ in fields] for sv, fields in sats.items()}, {sv: flags.get(sv, "") for sv in sats}
        for sv, fields in sats.items():
            tokens = [arc.token(None if x is None else x[0]) for arc, x in zip(arcs[sv], fields, strict=True)]
            new = "".join("  " if x is None else x[1] + x[2] for x in fields)
            yield (" ".join(tokens) + " " + changes(flags[sv], new)).rstrip()
            flags[sv] = new
