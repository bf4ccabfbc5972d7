"""Columns of the log line and event grammar. Nothing here fails on a bad line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.schemas import LEVELS

_UNSIGNED = r"^\+?[0-9]+$"
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_BIG, _NAN = ("inf", "infinity"), ("nan", "+nan", "-nan")
#: The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that are computed once a row: later filters and projections read their
    values, and the optimizer does not put the expressions in their place."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def unpadded(c: Column) -> Column:
    """``strip`` of a column: where no white space is at the ends there is nothing to look for in between."""
    space = F.lit(WHITE_SPACE)
    bare = (F.instr(space, F.substring(c, 1, 1)) == 0) & (F.instr(space, F.substring(c, -1, 1)) == 0)
    return F.when(bare, c).otherwise(strip(c))


def unsigned(c: Column, bits: int) -> Column:
    """An unsigned whole number that fits the bits (fewer than 63); null otherwise."""
    n = c.try_cast("long")
    fits = n < (1 << bits)
    # what is written as Spark would write it needs no pattern
    return F.when((n >= 0) & fits & (n.cast("string") == c), n).when(c.rlike(_UNSIGNED) & fits, n)


def real(c: Column) -> Column:
    """A floating-point number; null otherwise."""
    low = F.lower(c)
    special = (
        F.when(low.isin(*_BIG, *("+" + x for x in _BIG)), F.lit(float("inf")))
        .when(low.isin(*("-" + x for x in _BIG)), F.lit(float("-inf")))
        .when(low.isin(*_NAN), F.lit(float("nan")))
    )
    return F.when(c.rlike(_FLOAT), c.try_cast("double")).otherwise(special)


def seconds_to_micros(seconds: Column) -> Column:
    """Seconds to whole microseconds, by way of whole nanoseconds; null where no time can be."""
    fits = (seconds >= 0) & (seconds < F.lit(9.0e9))
    return F.when(fits, F.floor(F.rint(seconds * F.lit(1e9)) / 1000).cast("long"))


def normal_level(c: Column) -> Column:
    """Upper-case name of a known level; null otherwise."""
    up = F.upper(strip(c))
    return F.when(c.isin(*LEVELS), c).when(up.isin(*LEVELS), up)


def level_cname(level: Column) -> Column:
    return F.when(level.isin("WARN", "ERROR"), F.lit("terrible")).otherwise(F.lit("good"))


def seconds_text(ts_us: Column) -> Column:
    """``%.6f`` of the seconds. Below 1e15 the double is so near that its six digits are those of the microseconds."""
    exact = F.concat(((ts_us - ts_us % 1_000_000) / 1_000_000).cast("long").cast("string"), F.lit("."), F.lpad((ts_us % 1_000_000).cast("string"), 6, "0"))
    return F.when((ts_us >= 0) & (ts_us < 10**15), exact).otherwise(F.format_string("%.6f", ts_us / F.lit(1e6)))


def format_log_line(ts_us: Column, level: Column, message: Column) -> Column:
    shown = (F.coalesce(x, F.lit("null")) for x in (level, message))
    return F.concat(seconds_text(ts_us), F.lit(" ["), next(shown), F.lit("] "), next(shown))


def short_symbol(c: Column) -> Column:
    """The name before its pool suffix."""
    return F.substring_index(c, "::POOL", 1)


def display_name(symbol: Column, kind: str, number: Column) -> Column:
    return F.coalesce(symbol, F.concat(F.lit(f"{kind} 0x"), F.hex(number)))


def after_last(args: Column, key: str) -> Column:
    """What follows the last ``key`` in ``args``."""
    return F.substring_index(args, key, -1)


def param(args: Column, key: str, last: Column | None = None) -> Column:
    """``=value`` of the last ``key=value`` among ``k=v,…``; empty where there is none. ``last`` is ``after_last``
    of them: where it starts with ``=`` and the key before it is at the start, or after a comma and at most one
    blank, no later pair can have that key, and no pattern is needed."""
    last = after_last(args, key) if last is None else last
    head = F.substring(args, F.lit(1), F.length(args) - F.length(last) - len(key))
    plain = F.startswith(last, F.lit("=")) & (F.length(last) < F.length(args)) & ((head == "") | F.endswith(head, F.lit(",")) | F.endswith(head, F.lit(", ")))
    return F.when(plain, F.substring_index(last, ",", 1)).otherwise(F.regexp_extract(args, rf"(?s)^(?:.*,)?(?U:\s*){key}(?U:\s*)(=[^,]*)", 1))


def value(found: Column) -> Column:
    """The text of what ``param`` found; null where it found nothing."""
    return F.when(found != "", unpadded(F.substring(found, 2, 1 << 30)))


def parse_params(args: Column) -> Column:
    """``k=v,…`` to a map: pieces without ``=`` are dropped, ends are trimmed, the last of equal keys wins."""

    def pair(piece, i):
        at = F.instr(piece, "=")
        return F.struct(strip(F.substring(piece, F.lit(1), at - 1)).alias("k"), i.alias("i"), F.when(at > 0, strip(F.substring(piece, at + 1, F.length(piece)))).alias("v"))

    def last_of_key(pairs):
        # sorted by key and place: an entry stays if the next one has another key
        return F.filter(pairs, lambda x, j: F.coalesce(F.get(pairs, j + 1)["k"] != x["k"], F.lit(True)))

    pairs = F.array_sort(F.filter(F.transform(F.split(args, ","), pair), lambda x: x["v"].isNotNull()))
    kept = F.get(F.transform(F.array(pairs), last_of_key), F.lit(0))
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"], x["v"])))
