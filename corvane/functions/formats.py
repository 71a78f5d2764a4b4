"""Display formats as string columns. Nulls show the empty text; 0, false and '' don't count as empty."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "—"
CURRENCIES = {"CNY": "¥", "USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥"}


def _shown(c: Column, text: Column, empty: str) -> Column:
    return F.when(c.isNull(), F.lit(empty)).otherwise(text)


def _fixed(v: Column, decimals: int, grouping: bool) -> Column:
    """Half away from zero, on the decimal text of the number; format_number alone rounds half to even."""
    text = F.format_number(F.round(v, decimals), decimals)
    return text if grouping else F.replace(text, F.lit(","))


def number(c: Column, style: str = "standard", decimals: int = 2, grouping: bool = True, source: str = "ratio", currency: str = "CNY", prefix: str = "", suffix: str = "", empty: str = EMPTY) -> Column:
    """standard, percent (``source`` ratio or hundred), currency, scientific or compact."""
    v = c.cast("double")
    if style == "percent":
        text = F.concat(_fixed(v * 100 if source == "ratio" else v, decimals, grouping), F.lit("%"))
    elif style == "currency":
        text = F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.lit(CURRENCIES.get(currency, currency + " ")), _fixed(F.abs(v), decimals, grouping))
    elif style == "scientific":
        below = F.when(v == 0, 0).otherwise(F.floor(F.log10(F.abs(v)))).cast("int")
        # Rounding may give a tenth digit before the point: the next power has it as 1.
        power = below + F.when(F.round(F.abs(v) / F.pow(F.lit(10.0), below), decimals) >= 10, 1).otherwise(0)
        text = F.concat(_fixed(v / F.pow(F.lit(10.0), power), decimals, False), F.lit("E"), power.cast("string"))
    elif style == "compact":
        size = F.abs(v)
        text = F.coalesce(*[F.when(F.round(size / (s / 1000), decimals) >= 1000, F.concat(_fixed(v / s, decimals, False), F.lit(u))) for s, u in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K"))], _fixed(v, decimals, False))
    else:
        text = _fixed(v, decimals, grouping)
    return _shown(c, F.concat(F.lit(prefix), text, F.lit(suffix)), empty)


def template(c: Column, pattern: str, empty: str = EMPTY) -> Column:
    before, _, after = pattern.partition("{value}")
    return _shown(c, F.concat(F.lit(before), c.cast("string"), F.lit(after)), empty)


def mapping(c: Column, names: dict[str, str], empty: str = EMPTY) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return _shown(c, F.coalesce(pairs[c.cast("string")], c.cast("string")), empty)


def masked(c: Column, front: int = 2, back: int = 2, empty: str = EMPTY) -> Column:
    """The middle as stars; texts no longer than both ends become stars whole."""
    n = F.length(c)
    stars = F.concat(F.substring(c, 1, front), F.repeat(F.lit("*"), n - front - back), F.substring(c, -back, back))
    return _shown(c, F.when(n <= front + back, F.repeat(F.lit("*"), n)).otherwise(stars), empty)


def truncated(c: Column, most: int, empty: str = EMPTY) -> Column:
    return _shown(c, F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c), empty)


def cased(c: Column, style: str, empty: str = EMPTY) -> Column:
    return _shown(c, {"upper": F.upper, "lower": F.lower, "trim": F.trim}[style](c), empty)


def boolean(c: Column, yes: str, no: str, empty: str = EMPTY) -> Column:
    return _shown(c, F.when(c.cast("boolean"), F.lit(yes)).otherwise(F.lit(no)), empty)


def date(c: Column, pattern: str = "YYYY-MM-DD", empty: str = EMPTY) -> Column:
    """YYYY, MM and DD only."""
    return _shown(c, F.date_format(c, pattern.replace("YYYY", "yyyy").replace("DD", "dd")), empty)


def time(c: Column, zone: str = "Asia/Shanghai", pattern: str = "yyyy-MM-dd HH:mm:ss", empty: str = EMPTY) -> Column:
    """A UTC time in a zone."""
    return _shown(c, F.date_format(F.from_utc_timestamp(c.cast("timestamp"), zone), pattern), empty)


def relative(c: Column, now: Any, empty: str = EMPTY) -> Column:
    """How long before ``now``, in the largest whole unit."""
    s = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(c.cast("timestamp"))
    parts = [F.when(s >= n, F.concat(F.floor(s / n).cast("string"), F.lit(f" {u} ago"))) for n, u in ((86400, "days"), (3600, "hours"), (60, "minutes"))]
    return _shown(c, F.coalesce(*parts, F.lit("just now")), empty)


def listed(c: Column, separator: str = ", ", most: int = 100, empty: str = EMPTY) -> Column:
    """Joined elements, with a note of how many more there are."""
    head = F.array_join(F.transform(F.slice(c, 1, most), lambda x: x.cast("string")), separator)
    more = F.size(c) - most
    return _shown(c, F.when(more > 0, F.concat(head, F.lit(" … +"), more.cast("string"))).otherwise(head), empty)


def pairs(c: Column, fields: list[str], empty: str = EMPTY) -> Column:
    return _shown(c, F.concat_ws(", ", *[F.concat(F.lit(f"{f}: "), F.coalesce(c[f].cast("string"), F.lit(EMPTY))) for f in fields]), empty)


def series(c: Column, decimals: int = 2, empty: str = EMPTY) -> Column:
    """One line of time and value per point of an array<struct<timestamp, value>>."""
    line = F.transform(c, lambda p: F.concat(F.date_format(p["timestamp"], "yyyy-MM-dd HH:mm:ss"), F.lit("  "), number(p["value"], decimals=decimals)))
    return _shown(c, F.when(F.size(c) == 0, F.lit(empty)).otherwise(F.array_join(line, "\n")), empty)
