"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.
Beyond them every token with a digit or an at sign is a candidate, and so is every
run of groups of digits and capitals with single spaces between. Labelers vote
on candidates for, against or not at all: by shape (regular expressions), by
gazetteers of words around, and by context marks. Expectation-maximisation over
the counts of vote patterns estimates how reliable each labeler is; at most 3 to
the power of the labelers rows reach the driver. The posteriors are soft labels
for a naive Bayes classifier over hashed features of the candidates, and a
candidate it accepts that touches no base span becomes a span of kind ``secret``,
``contact`` or ``number``; parts of an accepted run are no spans of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base kinds; quantifiers that cannot give back are possessive, so long runs cost no stack.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"[A-Za-z0-9._%+@-]*[0-9@][A-Za-z0-9._%+@-]*"
#: Groups with a digit, at most one group of capitals only between two of them.
GROUPED = r"(?<![A-Za-z0-9._%+@-])[A-Z]*+[0-9][A-Z0-9]*+(?![A-Za-z0-9_%@])(?:\x20(?:[A-Z]++\x20)?[A-Z]*+[0-9][A-Z0-9]*+(?![A-Za-z0-9_%@]))++"
#: Gazetteers: words that stand before personal or secret values, and before harmless numbers.
TRIGGERS = ("token", "key", "secret", "password", "passwd", "pwd", "apikey", "api_key", "auth", "phone", "tel", "call", "mail", "email", "contact", "ssn", "passport", "iban", "account")
HARMLESS = ("version", "license", "licence", "by-nc", "by", "page", "chapter", "section", "figure", "table", "year", "no", "v")
BUCKETS, ROUNDS = 1024, 50
SPAN = "array<struct<start:int,end:int>>"


def spans(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """array<struct<start,end>> in code points of the leftmost non-overlapping matches that ``keep`` accepts, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        more = F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(keep(x["m"]), more).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _is_ip(m: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(part(p)) <= 3, part(p).try_cast("int") <= 255).otherwise(False))


def _is_card(m: Column) -> Column:
    return F.when(F.length(_digits(m)).between(14, 19), _luhn(m)).otherwise(False)


def base_spans(text: Column) -> Column:
    """array<struct<start,end,kind>> of the base kinds, by start and then kind; kind is a place in KINDS."""
    checks = (
        (text.contains("@"), EMAIL, lambda m: F.lit(True)),
        (text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), IP, _is_ip),
        (text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), CARD, _is_card),
        (text.contains("+"), PHONE, lambda m: F.length(_digits(m)).between(10, 15)),
    )
    kinds = []
    named = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"))
    for k, (worth, pattern, keep) in enumerate(checks):
        own = F.when(worth, spans(text, pattern, keep)).otherwise(F.array().cast(SPAN))
        kinds.append(F.transform(own, named(k)))
    return F.array_sort(F.concat(*kinds))


def _before(text: Column, start: Column, n: int) -> Column:
    return F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, start, end, token, before, after of each candidate."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    worth = docs.select(F.col("doc_id").cast("long"), text.alias("body")).filter(F.col("body").rlike("[0-9@]"))
    placed = worth.select("doc_id", F.xxhash64("body").alias("row_key"), "body", F.explode(F.concat(*(spans(F.col("body"), p, lambda m: F.lit(True)) for p in (CANDIDATE, GROUPED)))).alias("s"))
    token = F.substring(F.col("body"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return placed.select(
        "doc_id", "row_key", F.col("s.start").alias("start"), F.col("s.end").alias("end"), token.alias("token"),
        _before(F.col("body"), F.col("s.start"), 24).alias("before"), F.substring(F.col("body"), F.col("s.end") + 1, F.lit(2)).alias("after"),
    )


def _votes() -> dict[str, Column]:
    """1 for personal or secret, -1 against, 0 for no vote."""
    t, low = F.replace("token", F.lit(" ")), F.lower("before")
    digits = F.length(_digits(t))
    mixed = t.rlike("[0-9]") & t.rlike("[A-Za-z]")
    word = F.regexp_extract(low, r"([a-z_-]+)[^a-z]*$", 1)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    return {
        "shape": vote(t.rlike(r"^[^@]+@[^@]+\.[A-Za-z]{2,}$") | (mixed & (F.length(t) >= 14) & (digits >= 3)), t.rlike(r"^[0-9]{1,4}([.-][0-9]{1,2}){0,2}\.?$")),
        "length": vote(t.rlike(r"^[0-9-]+$") & digits.between(9, 19) | (F.length(t) >= 20), F.length(t) < 8),
        "gazetteer": vote(word.isin(*TRIGGERS), word.isin(*HARMLESS)),
        "context": vote(F.col("before").rlike(r"[=:\"']\s?$"), F.col("before").rlike(r"[a-z]\s$") & ~mixed & (digits < 9)),
        "case": vote(t.rlike("[0-9][A-Z]") & t.rlike("[A-Z]{2}|[A-Z][0-9]"), t.rlike("^[A-Za-z]+[0-9]?$")),
    }


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """Prior log-odds, and each labeler's log-odds per vote, by expectation-maximisation over counted vote patterns."""
    n_labelers = len(patterns[0][0]) if patterns else 0
    belief = {p: 1 / (1 + math.exp(-1.5 * sum(p))) for p, _ in patterns}
    prior, weights = 0.0, [dict.fromkeys((-1, 0, 1), 0.0) for _ in range(n_labelers)]
    for _ in range(rounds if patterns else 0):
        yes = sum(belief[p] * n for p, n in patterns) + 1
        no = sum((1 - belief[p]) * n for p, n in patterns) + 1
        prior = math.log(yes / no)
        for i in range(n_labelers):
            for v in (-1, 0, 1):
                # Half a vote goes to the side that the labeler speaks for, so that the sides keep their meaning.
                a = sum(belief[p] * n for p, n in patterns if p[i] == v) + (1.0 if v == 1 else 0.5)
                b = sum((1 - belief[p]) * n for p, n in patterns if p[i] == v) + (1.0 if v == -1 else 0.5)
                weights[i][v] = math.log(a / (yes + 1)) - math.log(b / (no + 1))
        belief = {p: 1 / (1 + math.exp(-max(-30.0, min(30.0, prior + sum(weights[i][v] for i, v in enumerate(p)))))) for p, _ in patterns}
    return prior, weights


def _features() -> dict[str, Column]:
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("token", "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9")
    word = F.regexp_extract(F.lower("before"), r"([a-z_-]+)[^a-z]*$", 1)
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS)).cast("int")
    return {
        "f_shape": bucket(F.substring(shape, 1, 8)),
        "f_word": bucket(word),
        "f_size": bucket(F.least(F.length("token"), F.lit(40)), F.length(_digits(F.col("token"))) > 8),
        "f_around": bucket(F.regexp_replace(F.substring("before", -2, 2), r"[\p{L}]", "a"), F.regexp_replace(F.substring("after", 1, 1), r"[\p{L}]", "a")),
    }


def classified(found: DataFrame) -> DataFrame:
    """The candidates with the final classifier's probability, trained on what the labelers' votes are worth."""
    votes = _votes()
    voted = written(found.withColumns(votes | _features()), "candidates")
    patterns = [(tuple(r[v] for v in votes), r["count"]) for r in voted.groupBy(*votes).count().collect()]
    prior, weights = reliabilities(patterns)
    odds = F.lit(prior)
    for name, w in zip(votes, weights):
        odds = odds + F.when(F.col(name) == 1, w[1]).when(F.col(name) == -1, w[-1]).otherwise(w[0])
    soft = voted.withColumn("belief", 1 / (1 + F.exp(-odds)))
    total = F.lit(0.0)
    for name in _features():
        # One row per hashed value: at most BUCKETS rows come to the driver and go back as one literal.
        table = {r["f"]: math.log((r["yes"] + 0.5) / (r["no"] + 0.5)) for r in soft.groupBy(F.col(name).alias("f")).agg(F.sum("belief").alias("yes"), F.sum(1 - F.col("belief")).alias("no")).collect()}
        values = F.split(F.lit(",".join(f"{table.get(k, 0.0) - prior:.6f}" for k in range(BUCKETS))), ",")
        total = total + values[F.col(name)].cast("double")
    return soft.withColumn("probability", 1 / (1 + F.exp(-(F.lit(prior) + total))))


def personal(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, base (array<struct<start,kind,end>>), added (array<struct<start,kind,end>>, kind a name).

    * Null text is empty. Offsets are code points, ends exclusive.
    * Repeated rows give the same row each; rows that share an id but not a text are kept apart; null ids are kept.
    * Without candidates nothing is added; an empty table gives an empty result; other columns are ignored.
    """
    scored = classified(candidates(docs)).filter(F.col("probability") >= threshold)
    kind = F.when(F.col("token").contains("@"), "contact").when(F.col("token").rlike("^[0-9.+ -]+$"), "number").otherwise("secret")
    added = scored.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list(F.struct("start", kind.alias("kind"), "end", F.col("token").contains(" ").alias("run")))).alias("added"))
    added = added.select(F.col("doc_id").alias("added_id"), F.col("row_key").alias("added_key"), "added")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("row_key"), base_spans(text).alias("base"))
    apart = F.filter("added", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    runs = F.filter("apart", lambda a: a["run"])
    whole = F.filter("apart", lambda a: a["run"] | ~F.exists("runs", lambda r: (r["start"] <= a["start"]) & (a["end"] <= r["end"])))
    shown = F.transform(whole, lambda a: F.struct(a["start"].alias("start"), a["kind"].alias("kind"), a["end"].alias("end")))
    joined = base.join(added, F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("row_key") == F.col("added_key")), "left")
    return joined.withColumn("apart", apart).withColumn("runs", runs).select(
        "doc_id", "base", F.when(F.col("added").isNull(), F.array().cast("array<struct<start:int,kind:string,end:int>>")).otherwise(shown).alias("added")
    )


def report(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    name = lambda b: F.element_at(F.array(*map(F.lit, KINDS)), b["kind"] + 1)
    show = lambda kind, s: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))
    base = F.array_join(F.transform("base", lambda b: show(name(b), b)), ",")
    # Added kinds sort after the base kinds, which stand in KINDS.
    everything = F.array_sort(
        F.concat(
            F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("place"), show(name(b), b).alias("shown"))),
            F.transform("added", lambda a: F.struct(a["start"].alias("start"), F.lit(len(KINDS)).alias("place"), show(a["kind"], a).alias("shown"))),
        )
    )
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return personal(docs, threshold).select(
        "doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform(everything, lambda s: s["shown"]), ",").alias("spans"),
    )
