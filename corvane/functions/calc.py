"""Formula expressions over typed inputs as Spark columns.

A formula such as ``IF({b} > 0, ROUND({a} / {b} * 100, 2), ERROR("no base"))`` is
checked token by token, rewritten to Spark SQL and left to Spark to parse and
type. Missing inputs, division by zero and results that aren't finite are errors
and never nulls. ``strict`` raises; ``collect`` gives a struct of value and error
per row, so that one bad row doesn't end a job.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CHARS, MOST_TOKENS, MOST_INPUTS, MOST_DEPTH = 500, 200, 50, 20
TOKEN = re.compile(r"""\s*(?:(?P<input>\{[^{}]+\})|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<text>"(?:[^"]|"")*"|'(?:[^']|'')*')|(?P<name>[A-Za-z_]+)|(?P<op><=|>=|!=|[-+*/=<>(),]))""")
ARITY = {"IF": (3, 3), "MIN": (2, 50), "MAX": (2, 50), "ABS": (1, 1), "ROUND": (1, 2), "ERROR": (1, 1)}
SPARK = {"IF": "if", "MIN": "least", "MAX": "greatest", "ABS": "abs", "ROUND": "round", "ERROR": "raise_error"}


class FormulaError(ValueError):
    """A formula that is refused before anything runs."""


def tokens(formula: str) -> list[tuple[str, str]]:
    if len(formula) > MOST_CHARS:
        raise FormulaError(f"longer than {MOST_CHARS} characters")
    out, at = [], 0
    while formula[at:].strip():
        m = TOKEN.match(formula, at)
        if not m:
            raise FormulaError(f"unexpected {formula[at:].strip()[:10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    if len(out) > MOST_TOKENS:
        raise FormulaError(f"more than {MOST_TOKENS} parts")
    return out


def inputs(formula: str) -> list[str]:
    return list(dict.fromkeys(t[1:-1] for kind, t in tokens(formula) if kind == "input"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spark_sql(formula: str, columns: Mapping[str, str]) -> str:
    """The formula as Spark SQL over ``columns`` (input to column name). Operands are checked for null, quotients for zero."""
    parts, depth, calls, out = tokens(formula), 0, [], []
    if len(columns) > MOST_INPUTS:
        raise FormulaError(f"more than {MOST_INPUTS} inputs")
    for i, (kind, t) in enumerate(parts):
        if kind == "input":
            if t[1:-1] not in columns:
                raise FormulaError(f"unknown input {t[1:-1]!r}")
            column = f"`{columns[t[1:-1]]}`"
            out.append(f"nvl({column}, raise_error({_quoted('missing input ' + t[1:-1])}))")
        elif kind == "number":
            out.append(f"{float(t)!r}D")
        elif kind == "text":
            out.append(_quoted(t[1:-1].replace(t[0] * 2, t[0])))
        elif kind == "name":
            if t.upper() in ("TRUE", "FALSE"):
                out.append(t.upper())
            elif t.upper() in ARITY and parts[i + 1 : i + 2] == [("op", "(")]:
                out.append(SPARK[t.upper()])
            else:
                raise FormulaError(f"unknown function {t!r}")
        elif t == "(":
            depth += 1
            before = parts[i - 1] if i else ("", "")
            calls.append([before[1].upper() if before[0] == "name" else "", 1, i])
            out.append(t)
        elif t in "),":
            if not calls or (t == "," and not calls[-1][0]):
                raise FormulaError(f"unexpected {t!r}")
            name, n, at = calls[-1]
            if t == ",":
                calls[-1][1] += 1
            else:
                calls.pop()
                depth -= 1
                n = 0 if at == i - 1 else n
                if name and not ARITY[name][0] <= n <= ARITY[name][1]:
                    raise FormulaError(f"{name} takes {ARITY[name][0]} to {ARITY[name][1]} arguments")
                if name == "ROUND" and n == 2 and not re.fullmatch(r"[0-6]", parts[i - 1][1]):
                    raise FormulaError("ROUND takes 0 to 6 places")
                if name == "ROUND" and n == 2:
                    out[-1] = parts[i - 1][1]
            out.append(t)
        else:
            out.append(t)
        if depth > MOST_DEPTH:
            raise FormulaError(f"deeper than {MOST_DEPTH}")
    if calls:
        raise FormulaError("a bracket isn't closed")
    if sum(t == "-" for t in out) > MOST_DEPTH and re.search(r"(- ?){%d}" % MOST_DEPTH, " ".join(out)):
        raise FormulaError(f"deeper than {MOST_DEPTH}")
    return " ".join(out)


def strict(formula: str, columns: Mapping[str, str], number: bool = True) -> Column:
    """The formula's value; rows with an error end the query. ``number`` adds the check that the result is finite."""
    value = F.expr(spark_sql(formula, columns))
    if not number:
        return value
    value = value.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.lit("the result is not finite"))).otherwise(value)


def collect(formula: str, columns: Mapping[str, str]) -> Column:
    """struct<value: double, error: string>: the first error of what is evaluated, and no value with it.

    Errors are missing inputs, divisions by zero, ERROR, and results that aren't finite. Each part of the formula is a
    pair of columns, value and error, and passes on the first error of its operands; IF those of its condition and of
    the branch that it takes.
    """
    spark_sql(formula, columns)
    names = inputs(formula)
    write = {"input": lambda t: f"_{names.index(t[1:-1])}", "text": lambda t: repr(t[1:-1].replace(t[0] * 2, t[0])), "name": lambda t: t.title() if t.upper() in ("TRUE", "FALSE") else t.upper(), "op": lambda t: "==" if t == "=" else t}
    try:
        tree = ast.parse(" ".join(write.get(kind, lambda t: repr(float(t)))(t) for kind, t in tokens(formula)), mode="eval")
    except SyntaxError as x:
        raise FormulaError("the formula isn't complete") from x
    value, error = _pair(tree.body, [(n, F.col(f"`{columns[n]}`")) for n in names])
    value = value.try_cast("double")
    error = F.coalesce(error, _unless_finite(value))
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


NO_ERROR = "CAST(NULL AS STRING)"
OF_OPERATOR = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__", ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}


def _unless_finite(value: Column) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit("the result is not finite"))


def _pair(node: ast.expr, named: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """Value and error of a part of a formula."""
    if isinstance(node, ast.Constant):
        return F.lit(node.value), F.expr(NO_ERROR)
    if isinstance(node, ast.Name):
        name, column = named[int(node.id[1:])]
        return column, F.when(column.isNull(), F.lit(f"missing input {name}"))
    if isinstance(node, ast.UnaryOp):
        value, error = _pair(node.operand, named)
        value = value.try_cast("double")
        return -value if isinstance(node.op, ast.USub) else value, error
    if isinstance(node, ast.BinOp):
        (x, x_error), (y, y_error) = (_pair(n, named) for n in (node.left, node.right))
        x, y = x.try_cast("double"), y.try_cast("double")
        if isinstance(node.op, ast.Div):
            value, own = F.when(y != 0, x / F.nullif(y, F.lit(0.0))), F.when(y == 0, F.lit("division by zero"))
        else:
            value, own = getattr(x, OF_OPERATOR[type(node.op)])(y), F.expr(NO_ERROR)
        return value, F.coalesce(x_error, y_error, own, _unless_finite(value))
    if isinstance(node, ast.Compare):
        if len(node.ops) > 1:
            raise FormulaError("comparisons can't be chained")
        (x, x_error), (y, y_error) = (_pair(n, named) for n in (node.left, node.comparators[0]))
        return getattr(x, OF_OPERATOR[type(node.ops[0])])(y), F.coalesce(x_error, y_error)
    if not isinstance(node, ast.Call):
        raise FormulaError("unexpected part of a formula")
    name, parts = node.func.id, [_pair(n, named) for n in node.args]
    if name == "IF":
        (test, test_error), (yes, yes_error), (no, no_error) = parts
        return F.when(test, yes).otherwise(no), F.coalesce(test_error, F.when(test, yes_error).otherwise(no_error))
    errors = F.coalesce(*(e for _, e in parts))
    if name == "ERROR":
        return F.lit(None).cast("double"), F.coalesce(errors, parts[0][0].cast("string"))
    values = [v.try_cast("double") for v, _ in parts]
    if name == "ROUND":
        places = int(node.args[1].value) if len(parts) == 2 else 0
        return F.round(values[0], places), parts[0][1]
    return {"MIN": F.least, "MAX": F.greatest, "ABS": F.abs}[name](*values), errors
