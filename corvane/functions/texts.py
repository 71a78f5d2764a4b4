"""Helpers over texts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed lists of the upload rules: suffixes never and not usually taken, and folders left out.
NEVER = ("exe", "dll", "so", "class", "jar", "parquet", "avro", "zip")
SELDOM = ("log", "tmp", "bak", "lock")
FOLDERS = ("node_modules", ".git", "dist", "__pycache__")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def upload_verdict(path: Column, allow: tuple[str, ...] = ()) -> Column:
    """hard, allowed, soft or taken, in this order of rules."""
    folder = path.rlike("(^|/)(" + "|".join(f.replace(".", r"\.") for f in FOLDERS) + ")/")
    return F.when(suffix(path).isin(*NEVER) | folder, "hard").when(suffix(path).isin(*allow) if allow else F.lit(False), "allowed").when(suffix(path).isin(*SELDOM), "soft").otherwise("taken")


def redacted(c: Column) -> Column:
    """Values after password-like names, and bearer tokens, as stars."""
    named = F.regexp_replace(c, r"(?i)((?:password|passwd|secret|token|api_?key)\s*[=:]\s*)\S+", "$1***")
    return F.regexp_replace(named, r"(?i)(bearer\s+)[A-Za-z0-9._-]+", "$1***")


def token_estimate(c: Column, messages: int = 1) -> Column:
    """UTF-8 bytes and 32 for each message: an upper estimate."""
    return F.octet_length(c).cast("long") + 32 * messages


def output_budget(slots: Column, tokens_in: Column) -> Column:
    return F.greatest(F.lit(1024), 256 * slots + F.ceil(0.25 * tokens_in)).cast("long")


def url(template: str, **values: Column) -> Column:
    """A URL whose {name} parts are percent-encoded values."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), F.replace(F.url_encode(values[name].cast("string")), F.lit("+"), F.lit("%20"))]
    return F.concat(*out, F.lit(rest))


def coordinate(c: Column, least: float, most: float) -> Column:
    """A degree within bounds, else null."""
    v = c.try_cast("double")
    return F.when(v.between(least, most), v)


def terms(c: Column) -> Column:
    """Words of ASCII letters and digits, lower-cased, and pairs of neighbouring CJK characters."""
    ascii_ = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))
    cjk = F.regexp_extract_all(c, F.lit("[\\x{4e00}-\\x{9fff}]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(cjk, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))
    return F.array_distinct(F.concat(ascii_, pairs))


def conflicting(include: Column, exclude: Column) -> Column:
    """Terms on both lists, without regard to case."""
    low = lambda a: F.transform(a, F.lower)
    return F.array_sort(F.array_intersect(low(include), low(exclude)))


def nearest_rank(value: str, share: float) -> Column:
    """The nearest-rank percentile of a column's values, as an aggregate; nulls don't count."""
    return F.expr(f"percentile_disc({share!r}D) WITHIN GROUP (ORDER BY `{value}`)")


def object_path(path: Column) -> Column:
    """The nearest object of a key path: the path without its last key, or as it is if that is an array's element; '' for the root."""
    bare = F.btrim(F.regexp_replace(F.coalesce(path, F.lit("")), r"^\$", ""), F.lit("."))
    parts = F.filter(F.split(bare, r"\."), lambda x: x != "")
    last = F.try_element_at(parts, F.lit(-1))
    return F.when(F.size(parts) == 0, "").when(last.contains("["), bare).when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")).otherwise("")


def array_summary(c: Column, most: int = 5000) -> Column:
    """length, types (how many of the first ``most`` elements are of each JSON type) and keys of the first object, of a JSON array in a string."""
    items = F.try_parse_json(c).cast("array<variant>")
    types = F.transform(F.slice(items, 1, most), lambda x: F.lower(F.regexp_extract(F.coalesce(F.schema_of_variant(x), F.lit("VOID")), "^[A-Z]+", 0)))
    named = F.transform(F.array_sort(F.array_distinct(types)), lambda k: F.concat(k, F.lit("="), F.size(F.filter(types, lambda x: x == k)).cast("string")))
    first = F.try_element_at(F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT")), F.lit(1))
    return F.struct(F.size(items).alias("length"), F.array_join(named, ",").alias("types"), F.array_join(F.json_object_keys(F.to_json(first)), ",").alias("keys"))
