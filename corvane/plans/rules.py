"""Query rules: steps of SQL where a step's single row feeds the later ones."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from corvane.functions.sqltemplate import read_only

PARAM = re.compile(r"(?<![:\w]):(\w+)\.(\w+)")
NAME = re.compile(r"\{\{\s*(\w+)\.(\w+)\s*\}\}")


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    name: str
    sql: str
    many: bool = False


def steps_of(text: str) -> list[Step]:
    """Segments that start with ``-- @step name one|many``."""
    parts = re.split(r"(?m)^\s*--\s*@step\s+(\w+)\s+(one|many)\s*$", text)
    if parts[0].strip() or len(parts) < 4:
        raise RuleError("a template begins with -- @step name one|many")
    return [Step(name, sql.strip(), kind == "many") for name, kind, sql in zip(parts[1::3], parts[2::3], parts[3::3])]


@dataclass
class Rule:
    """Steps in order; the last, or ``result``, is the answer. Only earlier ``one`` steps may be referred to.

    ``:input`` and ``:step.column`` are bound as arguments; ``{{step.column}}`` becomes an identifier and
    must be a plain name.
    """

    steps: list[Step]
    result: str | None = None
    found: dict[str, dict[str, Any]] = field(default_factory=dict)

    def check(self) -> None:
        names = [s.name for s in self.steps]
        if len(set(names)) < len(names):
            raise RuleError("step names repeat")
        single: set[str] = set()
        for s in self.steps:
            for name, _ in PARAM.findall(s.sql) + NAME.findall(s.sql):
                if name not in single:
                    raise RuleError(f"step {s.name} refers to {name}, which is no earlier step of one row")
            read_only(NAME.sub("x", s.sql))
            if not s.many:
                single.add(s.name)

    def run(self, spark: SparkSession, **inputs: Any) -> DataFrame:
        """The result step as a DataFrame. Steps of one row are read by the driver, since later ones need their values; no row or two are an error."""
        self.check()
        self.found = {}
        wanted = self.result or self.steps[-1].name
        for s in self.steps:
            args = dict(inputs)

            def bind(m: re.Match, args=args) -> str:
                args[f"{m[1]}__{m[2]}"] = self.found[m[1]][m[2]]
                return f":{m[1]}__{m[2]}"

            def identifier(m: re.Match) -> str:
                v = str(self.found[m[1]][m[2]])
                if not re.fullmatch(r"[A-Za-z_]\w*", v):
                    raise RuleError(f"{v!r} is no plain name")
                return f"`{v}`"

            sql = PARAM.sub(bind, NAME.sub(identifier, s.sql))
            used = {k: v for k, v in args.items() if re.search(rf":{k}\b", sql)}
            df = spark.sql(read_only(sql), args=used)
            if s.name == wanted and (s.many or s is self.steps[-1]):
                return df
            if not s.many:
                rows = df.limit(2).collect()
                if len(rows) != 1:
                    raise RuleError(f"step {s.name} found {'no row' if not rows else 'several rows'}")
                self.found[s.name] = rows[0].asDict()
                if s.name == wanted:
                    return df
        raise RuleError(f"no step {wanted!r}")
