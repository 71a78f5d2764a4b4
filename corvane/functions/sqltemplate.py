"""Dynamic SQL text with if, choose, where, set, trim and foreach, rendered to Spark SQL with named arguments.

Values are always bound as arguments. Raw ``${name}`` takes identifiers only. The
tags are XML; tests are Python-like comparisons over the parameters and are
walked as a syntax tree of a few allowed nodes, never run.
"""

from __future__ import annotations

import ast
import re
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

TAGS = {"if", "choose", "when", "otherwise", "where", "set", "trim", "foreach"}
MOST_CHARS, MOST_DEPTH = 50_000, 8
BOUND = re.compile(r"#\{\s*([\w.]+)\s*\}")
RAW = re.compile(r"\$\{\s*(\w+)\s*\}")
COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}


class TemplateError(ValueError):
    pass


def truth(test: str, params: dict[str, Any]) -> bool:
    """A test: and, or, not, comparisons, literals; a bare parameter asks whether it isn't null."""
    text = re.sub(r"\bnull\b", "None", re.sub(r"\btrue\b", "True", re.sub(r"\bfalse\b", "False", test)))
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise TemplateError(f"test {test!r}: {e.msg}") from e

    def value(n: ast.AST) -> Any:
        if isinstance(n, ast.Constant):
            return n.value
        if isinstance(n, ast.Name):
            if n.id not in params:
                raise TemplateError(f"undeclared parameter {n.id!r}")
            return params[n.id]
        raise TemplateError(f"test {test!r} is not allowed")

    def holds(n: ast.AST) -> bool:
        if isinstance(n, ast.BoolOp):
            return all(map(holds, n.values)) if isinstance(n.op, ast.And) else any(map(holds, n.values))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return not holds(n.operand)
        if isinstance(n, ast.Compare) and len(n.ops) == 1 and type(n.ops[0]) in COMPARE:
            a, b = value(n.left), value(n.comparators[0])
            if (a is None or b is None) and not isinstance(n.ops[0], (ast.Eq, ast.NotEq)):
                raise TemplateError(f"test {test!r} orders a null")
            return COMPARE[type(n.ops[0])](a, b)
        got = value(n)
        return got if isinstance(got, bool) else got is not None

    return holds(tree)


def parsed(template: str) -> ElementTree.Element:
    if len(template) > MOST_CHARS:
        raise TemplateError(f"longer than {MOST_CHARS} characters")
    # Comparison signs in SQL text are no tags.
    safe = re.sub(r"<(?!/?(?:%s)\b)" % "|".join(sorted(TAGS)), "&lt;", re.sub(r"&(?!\w+;)", "&amp;", template))
    safe = re.sub(r'(test="[^"]*")', lambda m: m[1].replace("<", "&lt;"), safe)
    try:
        root = ElementTree.fromstring(f"<t>{safe}</t>")
    except ElementTree.ParseError as e:
        raise TemplateError(str(e)) from e

    def check(n: ElementTree.Element, depth: int) -> None:
        if depth > MOST_DEPTH:
            raise TemplateError(f"deeper than {MOST_DEPTH}")
        if n.tag == "choose" and any(c.tag not in ("when", "otherwise") for c in n):
            raise TemplateError("choose holds when and otherwise only")
        for c in n:
            check(c, depth + 1)

    check(root, 0)
    return root


def parameters(template: str) -> list[str]:
    """Names that the template reads: bound, raw, collections and tests; loop variables are not parameters."""
    root = parsed(template)
    local = {n.get(k) for n in root.iter("foreach") for k in ("item", "index") if n.get(k)}
    names: list[str] = []
    for n in root.iter():
        for text in (n.text, n.tail):
            names += [x.split(".")[0] for x in BOUND.findall(text or "")] + RAW.findall(text or "")
        if n.get("collection"):
            names.append(n.get("collection"))
        if n.get("test"):
            text = re.sub(r"\b(null|true|false)\b", "None", n.get("test"))
            names += [x.id for x in ast.walk(ast.parse(text.strip(), mode="eval")) if isinstance(x, ast.Name)]
    return [x for x in dict.fromkeys(names) if x not in local]


def checked(template: str, declared: set[str]) -> list[tuple[str, str]]:
    """Diagnostics (level, message): undeclared parameters are errors; unused and raw ones are warnings."""
    used = parameters(template)
    out = [("error", f"undeclared parameter {n}") for n in used if n not in declared]
    out += [("warning", f"unused parameter {n}") for n in sorted(declared - set(used))]
    return out + [("warning", f"raw text ${{{n}}}") for n in dict.fromkeys(RAW.findall(template))]


def render(template: str, params: dict[str, Any]) -> tuple[str, dict[str, Any]]:
    """SQL text with named arguments, and the arguments."""
    args: dict[str, Any] = {}

    def bind(v: Any) -> str:
        args[f"p{len(args)}"] = v
        return f":p{len(args) - 1}"

    def text(s: str | None, scope: dict[str, Any]) -> str:
        def look(path: str) -> Any:
            head, *rest = path.split(".")
            if head not in scope:
                raise TemplateError(f"undeclared parameter {head!r}")
            v = scope[head]
            for part in rest:
                v = v[part]
            return v

        def raw(m: re.Match) -> str:
            v = str(look(m[1]))
            if not re.fullmatch(r"\w+(\.\w+)*", v):
                raise TemplateError(f"raw text {v!r} is no identifier")
            return v

        return BOUND.sub(lambda m: bind(look(m[1])), RAW.sub(raw, s or ""))

    def inside(n: ElementTree.Element, scope: dict[str, Any]) -> str:
        return text(n.text, scope) + "".join(node(c, scope) + text(c.tail, scope) for c in n)

    def trimmed(body: str, prefix: str, strip_front: list[str], strip_back: list[str]) -> str:
        body = body.strip()
        for word in strip_front:
            if re.match(re.escape(word) + (r"\b" if word[-1].isalnum() else ""), body, re.I):
                body = body[len(word) :].strip()
                break
        for word in strip_back:
            if body.upper().endswith(word.upper()):
                body = body[: -len(word)].strip()
                break
        return f" {prefix} {body} " if body else " "

    def node(n: ElementTree.Element, scope: dict[str, Any]) -> str:
        if n.tag == "if":
            return inside(n, scope) if truth(n.get("test", ""), scope) else ""
        if n.tag == "choose":
            return next((inside(c, scope) for c in n if c.tag == "otherwise" or truth(c.get("test", ""), scope)), "")
        if n.tag == "where":
            return trimmed(inside(n, scope), "WHERE", ["AND", "OR"], [])
        if n.tag == "set":
            return trimmed(inside(n, scope), "SET", [], [","])
        if n.tag == "trim":
            split = lambda k: [x.strip() for x in n.get(k, "").split("|") if x.strip()]
            return trimmed(inside(n, scope), n.get("prefix", ""), split("prefixOverrides"), split("suffixOverrides"))
        values = scope.get(n.get("collection", ""))
        if not isinstance(values, (list, tuple)):
            raise TemplateError(f"{n.get('collection')!r} is not a list")
        pieces = [inside(n, scope | {n.get("item", "item"): v, n.get("index", "index"): i}).strip() for i, v in enumerate(values)]
        return n.get("open", "") + n.get("separator", ", ").join(p for p in pieces if p) + n.get("close", "")

    return inside(parsed(template), params).strip(), args


def one_query(sql: str) -> str:
    """The text, if it begins as a query, is one statement and runs no script (USING and a text). To be put in parentheses: see ``read_only``."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", "''", sql, flags=re.S)
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", bare, flags=re.S).strip().rstrip(";")
    if ";" in bare or not re.match(r"(?i)(select|with|from|values)\b", bare) or re.search(r"(?i)\busing\s+''", bare):
        raise TemplateError("one SELECT is asked for")
    return sql.strip().rstrip(";")


def read_only(sql: str) -> str:
    """``one_query`` as a subquery. Spark's grammar takes nothing but a query in parentheses, so its parser refuses a write wherever it stands, after WITH or FROM as well."""
    return f"SELECT * FROM (\n{one_query(sql)}\n)"


def run(spark: SparkSession, template: str, params: dict[str, Any]) -> DataFrame:
    sql, args = render(template, params)
    return spark.sql(read_only(sql), args=args)
