"""Column builders for fixed-width fields, packed dates, satellite names and integer code lengths.

All are built-in expressions; bad input gives null, never an exception, also under ANSI mode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_fixed(text: Column | str, frac: int) -> Column:
    """Blanks, optional minus, digits, a point, up to frac digits; times 10^frac, as a long.

    A point alone is 0; digits that are missing behind the point are zeros; no plus, no exponent.
    """
    t = F.trim(F.regexp_replace(col(text), "[\r\n]", " "))
    good = col(text).rlike("^ *-?[0-9]*[.][0-9]{0,%d}[ \r\n]*$" % frac)
    digits = F.regexp_replace(t, "[-.]", "")
    kept = F.length(F.substring_index(t, ".", -1))
    size = F.coalesce(F.nullif(digits, F.lit("")), F.lit("0")).try_cast("bigint")
    scaled = size * F.pow(F.lit(10.0), frac - kept).cast("bigint")
    return F.when(good, F.when(t.startswith("-"), -scaled).otherwise(scaled))


def parse_uint(text: Column | str) -> Column:
    """Leading blanks, then digits only; all blank is 0; a blank after a digit is an error (null)."""
    t = col(text)
    return F.when(F.trim(t) == "", F.lit(0)).when(t.rlike("^ *[0-9]+$"), F.trim(t).try_cast("int"))


def obs_value(field: Column) -> Column:
    """F14.3 at the start of a 16-character field, times 1000, without a regular expression: the point
    is the 11th character; blank digits behind it, after the others, are zeros; no plus."""
    frac = F.rpad(F.rtrim(F.substring(field, 12, 3)), 3, "0")
    number = F.concat(F.ltrim(F.substring(field, 1, 10)), frac)
    good = (F.substring(field, 11, 1) == ".") & ~F.contains(number, F.lit(" ")) & ~F.contains(number, F.lit("+"))
    return F.when(good, number.try_cast("bigint"))


def obs_struct(field: Column) -> Column:
    """value_e3, lli, ssi of a field padded to 16 characters; null for a blank field."""
    f = F.rpad(field, 16, " ")
    return F.when(f != " " * 16, F.struct(obs_value(f).alias("value_e3"), F.substring(f, 15, 1).alias("lli"), F.substring(f, 16, 1).alias("ssi")))


def render_obs(value_e3: Column, lli: Column, ssi: Column) -> Column:
    """The 16 characters of an observation; blanks where the value is null."""
    whole = F.format_string("%d.%03d", F.floor(F.abs(value_e3) / 1000).cast("bigint"), F.abs(value_e3) % 1000)
    signed = F.concat(F.when(value_e3 < 0, "-").otherwise(""), whole)
    return F.when(value_e3.isNull(), F.lit(" " * 16)).otherwise(F.concat(F.lpad(signed, 14, " "), F.coalesce(lli, F.lit(" ")), F.coalesce(ssi, F.lit(" "))))


def crx_int(text: Column) -> Column:
    """The integer that a compressed field starts with."""
    return F.nullif(F.regexp_extract(text, "^(-?[0-9]+)", 1), F.lit("")).try_cast("bigint")


def crx_kind(text: Column) -> Column:
    """empty, start (of an arc, `N&v`), delta or bad."""
    return F.when(F.coalesce(text, F.lit("")) == "", "empty").when(text.rlike("^[0-9]&-?[0-9]+$"), "start").when(text.rlike("^-?[0-9]+$"), "delta").otherwise("bad")


def sv_name(system: Column, prn: Column) -> Column:
    return F.concat(system, F.lpad(prn.cast("string"), 2, "0"))


def sv_prn(sv: Column) -> Column:
    return F.trim(F.substring(sv, 2, 2)).try_cast("int")


def system_hash(system: Column) -> Column:
    return F.ascii(system).bitwiseAND(31)


def pack_date(year: Column, month: Column, day: Column) -> Column:
    return (year * 10000 + month * 100 + day).cast("int")


def pack_minute(hour: Column, minute: Column) -> Column:
    return (hour * 100 + minute).cast("short")


def full_year(two_digits: Column) -> Column:
    return F.when(two_digits < 80, two_digits + 2000).otherwise(two_digits + 1900)


def expand_date(date: Column) -> Column:
    """Packed dates of two-digit years, below 1000000, in full."""
    return F.when(date >= 1000000, date).when(date < 800000, date + 20000000).otherwise(date + 19000000)


def packed_timestamp(date: Column, hh_mm: Column, sec_e7: Column) -> Column:
    """timestamp_ntz; microseconds, so the last decimal is lost, and second 60 is the next minute's 0."""
    base = F.to_timestamp_ntz(F.format_string("%08d %04d", date, hh_mm.cast("int")), F.lit("yyyyMMdd HHmm"))
    return base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (sec_e7 / 1e7).cast("decimal(18,6)"))


def split_time(t: Column) -> tuple[Column, Column]:
    """hours * 1e11 + minutes * 1e9 + seconds * 1e7 -> (hh_mm, sec_e7)."""
    hours, rest = F.floor(t / 100_000_000_000), t % 100_000_000_000
    return (hours * 100 + F.floor(rest / 1_000_000_000)).cast("short"), (rest % 1_000_000_000).cast("int")


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(1))


def uleb_length(u: Column) -> Column:
    """Bytes of an unsigned base-128 number; a negative long stands for 2^63 and more."""
    out = F.lit(10)
    for n in range(9, 0, -1):
        out = F.when((u >= 0) & (F.shiftright(u, 7 * n) == 0), n).otherwise(out) if n < 9 else F.when(u >= 0, 9).otherwise(out)
    return out


def sleb_length(v: Column) -> Column:
    return uleb_length(zigzag(v))


def sign_bits(v: Column) -> Column:
    """Leading bits equal to the sign, less one: 0 to 63."""
    m = v.bitwiseXOR(F.shiftright(v, 63))
    return F.when(m == 0, 63).otherwise(63 - F.length(F.bin(m)))


def scaled_double(value_e3: Column, scale: float = 1.0) -> Column:
    return value_e3.cast("double") * F.lit(scale / 1000.0)


def digest_length(kind: Column) -> Column:
    """Bytes of a digest by its id: none for 0, else two to the power of the id's low three bits."""
    return F.when(kind == 0, 0).otherwise(F.pow(F.lit(2), kind.bitwiseAND(7)).cast("int"))


def file_version(path: Column) -> Column:
    """3 for `*.rnx` and 2 for `*.NNo` names of 12 characters and more; null otherwise."""
    name = F.substring_index(path, "/", -1)
    return F.when(F.length(name) >= 12, F.when(name.rlike(r"(?i)\.rnx$"), 3).when(name.rlike(r"(?i)\.[0-9][0-9]o$"), 2))


def differences(value: Column, window, orders: int) -> list[Column]:
    """The nth differences of a column along a window order; null for the first n rows."""
    def nth(n: int) -> Column:  # binomial form: one window, no nesting
        terms = [(-1) ** k * _choose(n, k) * (F.lag(value, k).over(window) if k else value) for k in range(n + 1)]
        return reduce(lambda a, b: a + b, terms)

    return [nth(n) for n in range(1, orders + 1)]


def _choose(n: int, k: int) -> int:
    from math import comb

    return comb(n, k)
