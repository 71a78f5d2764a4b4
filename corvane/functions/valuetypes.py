"""Value-type constraints as columns that list what a value breaks."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
RID = r"^ri\.[a-z][a-z0-9-]*\.([a-z0-9][a-z0-9-]*)?\.[a-z][a-z0-9-]*\.[A-Za-z0-9._-]+$"
DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
MOST_ERRORS, MOST_PATTERN, MOST_TEXT = 20, 2048, 20_000


def _only(conditions: list[tuple[Column, str]], c: Column) -> Column:
    """The messages of the conditions that hold, at most 20; none for null."""
    found = F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in conditions]), lambda x: x.isNotNull())
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.slice(found, 1, MOST_ERRORS))


def scalar(c: Column, base: str) -> Column:
    """Violations of a base type by a text form: double, decimal, integer, boolean, date, dateTime, string."""
    number = c.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    good = {
        "string": F.lit(True), "double": finite, "decimal": finite, "integer": finite & (number == F.floor(number)),
        "boolean": c.cast("string").isin("true", "false"), "date": c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull(),
        "dateTime": c.rlike(DATETIME) & c.try_cast("timestamp").isNotNull(),
    }[base]
    return _only([(~F.coalesce(good, F.lit(False)), f"not a {base}")], c)


def in_range(c: Column, low: Any = None, high: Any = None, low_in: bool = True, high_in: bool = True, length: bool = False) -> Column:
    """Outside the bounds; ``length`` bounds the code points of a text."""
    v = F.length(c) if length else c
    bad = []
    if low is not None:
        bad.append((v < F.lit(low) if low_in else v <= F.lit(low), "too small"))
    if high is not None:
        bad.append((v > F.lit(high) if high_in else v >= F.lit(high), "too large"))
    return _only(bad, c)


def one_of(c: Column, values: list[Any], ignore_case: bool = False) -> Column:
    if ignore_case:
        return _only([(~F.lower(c).isin([str(v).lower() for v in values]), "not in list")], c)
    return _only([(~c.isin(values), "not in list")], c)


def matches(c: Column, pattern: str, whole: bool = True, ignore_case: bool = False) -> Column:
    if len(pattern) > MOST_PATTERN:
        raise ValueError("the pattern is too long")
    p = ("(?i)" if ignore_case else "") + (f"^(?:{pattern})$" if whole else pattern)
    return _only([(F.length(c) > MOST_TEXT, "too long for a pattern"), ((F.length(c) <= MOST_TEXT) & ~c.rlike(p), "no match")], c)


def uuid(c: Column) -> Column:
    return _only([(~c.rlike(UUID), "not a uuid")], c)


def rid(c: Column) -> Column:
    return _only([(~c.rlike(RID), "not a rid")], c)


def array(c: Column, least: int | None = None, most: int | None = None, unique: bool = False, each=None) -> Column:
    """``each`` gives the violations of an element; they carry its place."""
    bad = []
    if least is not None:
        bad.append((F.size(c) < least, "too few"))
    if most is not None:
        bad.append((F.size(c) > most, "too many"))
    if unique:
        bad.append((F.size(F.array_distinct(c)) < F.size(c), "not unique"))
    own = _only(bad, c)
    if each is None:
        return own
    inner = F.flatten(F.transform(c, lambda x, i: F.transform(each(x), lambda m: F.concat(F.lit("["), i.cast("string"), F.lit("] "), m))))
    return F.slice(F.concat(own, F.coalesce(inner, F.array().cast("array<string>"))), 1, MOST_ERRORS)


def struct(c: Column, required: list[str], fields: dict[str, Any]) -> Column:
    """Required fields, and the violations of each field under its name; other fields are free."""
    own = _only([(c[f].isNull(), f"{f}: required") for f in required], c)
    parts = [_named(f, check(c[f])) for f, check in fields.items()]
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.slice(F.concat(own, *parts), 1, MOST_ERRORS))


def _named(name: str, errors: Column) -> Column:
    return F.transform(errors, lambda m: F.concat(F.lit(f"{name}: "), m))


def cycle(definitions: dict[str, list[str]]) -> list[str]:
    """A chain of value types that refer to each other in a circle, or nothing; unknown references raise."""
    done: set[str] = set()

    def visit(name: str, path: list[str]) -> list[str]:
        if name not in definitions:
            raise ValueError(f"unknown value type {name!r}")
        if name in path:
            return path[path.index(name) :] + [name]
        if name in done:
            return []
        for other in definitions[name]:
            if found := visit(other, path + [name]):
                return found
        done.add(name)
        return []

    return next((c for n in definitions if (c := visit(n, []))), [])
