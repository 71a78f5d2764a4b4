"""Source material as facts: one row per thing that a file says.

Files come through Spark's binaryFile or text readers, so any store works; the
parsers see one file at a time inside a task.
"""

from __future__ import annotations

import configparser
import csv
import io
import json
import re
import tomllib
import zipfile
from collections.abc import Callable, Iterator
from itertools import batched
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACT = "path string, kind string, name string, line int, data string, quality string"
#: Facts that leave a task together; there is no cap on the facts of a file.
FACTS_AT_ONCE = 10_000
Fact = tuple[str, str, int, Any, str]


def _walk(value: Any, path: str) -> Iterator[tuple[str, Any]]:
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from _walk(v, f"{path}.{k}" if path else str(k))
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from _walk(v, f"{path}[{i}]")
    else:
        yield path, value


def json_facts(text: str) -> Iterator[Fact]:
    value = json.loads(text)
    graph = value.get("@graph") if isinstance(value, dict) else None
    for node in graph if isinstance(graph, list) else []:
        yield "node", str(node.get("@id", "")), 1, {"type": node.get("@type"), "name": node.get("name")}, "high"
    for path, leaf in _walk(value, ""):
        yield "leaf", path, 1, leaf, "high"


def jsonl_facts(text: str) -> Iterator[Fact]:
    for n, line in enumerate(text.splitlines(), 1):
        if line.strip():
            try:
                for path, leaf in _walk(json.loads(line), ""):
                    yield "leaf", path, n, leaf, "high"
            except ValueError as e:
                yield "failure", "line", n, str(e), "low"


def _kind(values: list[str]) -> str:
    kinds = (("integer", r"[+-]?\d+"), ("number", r"[+-]?\d*\.?\d+([eE][+-]?\d+)?"), ("boolean", r"(?i)true|false"), ("date", r"\d{4}-\d{2}-\d{2}"), ("datetime", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*"))
    return next((k for k, p in kinds if values and all(re.fullmatch(p, v) for v in values)), "text" if values else "empty")


def csv_facts(text: str) -> Iterator[Fact]:
    head = "\n".join(text.splitlines()[:20])
    delimiter = max(",;\t|", key=head.count)
    rows = list(csv.reader(io.StringIO(text), delimiter=delimiter))
    for i, name in enumerate(rows[0] if rows else []):
        values = [r[i] for r in rows[1:] if len(r) > i and r[i].strip()]
        yield "column", name, 1, {"type": _kind(values[:100]), "non_empty": len(values), "samples": list(dict.fromkeys(values))[:3]}, "high"
    for n, r in enumerate(rows[1:], 2):
        if len(r) != len(rows[0]):
            yield "ragged", "row", n, len(r), "low"


def ini_facts(text: str) -> Iterator[Fact]:
    parser = configparser.ConfigParser(interpolation=None, strict=False, allow_no_value=True)
    parser.optionxform = str
    parser.read_string(text)
    for section in parser.sections():
        for key, value in parser.items(section):
            yield "leaf", f"{section}.{key}", 1, value, "high"


def properties_facts(text: str) -> Iterator[Fact]:
    joined = re.sub(r"\\\r?\n[ \t]*", "", text)
    for n, line in enumerate(joined.splitlines(), 1):
        if line.strip() and line.lstrip()[0] not in "#!":
            key, value = re.match(r"\s*((?:\\.|[^=:\s\\])*)\s*[=:\s]?\s*(.*)", line).groups()
            yield "leaf", re.sub(r"\\(.)", r"\1", key), n, value, "high"


def toml_facts(text: str) -> Iterator[Fact]:
    for path, leaf in _walk(tomllib.loads(text), ""):
        yield "leaf", path, 1, str(leaf) if not isinstance(leaf, (str, int, float, bool)) else leaf, "high"


def yaml_facts(text: str) -> Iterator[Fact]:
    try:
        import yaml
    except ImportError:
        yield "failure", "yaml", 1, "no YAML parser is installed", "low"
        return
    for path, leaf in _walk(yaml.safe_load(text), ""):
        yield "leaf", path, 1, leaf if isinstance(leaf, (str, int, float, bool, type(None))) else str(leaf), "high"


def markdown_facts(text: str) -> Iterator[Fact]:
    fence = False
    for n, line in enumerate(text.splitlines(), 1):
        if line.lstrip().startswith("```"):
            fence = not fence
            if fence:
                yield "code", line.strip()[3:], n, "", "medium"
        elif not fence and (m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line)):
            yield "heading", m[2], n, len(m[1]), "high"
        elif not fence and re.match(r"\s*\|.*\|\s*$", line) and not re.match(r"[\s|:-]+$", line):
            yield "table_row", "", n, [c.strip() for c in line.strip().strip("|").split("|")], "high"
        elif not fence:
            for label, url in re.findall(r"\[([^\]]*)\]\(([^)\s]+)\)", line):
                yield "link", label, n, url, "high"


def ddl_facts(text: str) -> Iterator[Fact]:
    """Tables, columns with type and null, and keys of CREATE TABLE statements."""
    for m in re.finditer(r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"]?([\w.]+)[`\"]?\s*\((.*?)\)\s*(?:engine[^;]*|comment[^;]*)?;", text):
        table, line = m[1], text.count("\n", 0, m.start()) + 1
        yield "table", table, line, "", "high"
        for part in re.split(r",(?![^(]*\))", m[2]):
            part = re.sub(r"--[^\n]*", "", part).strip()
            at = line + m[2][: m[2].find(part)].count("\n")
            if key := re.match(r"(?i)(primary|unique|foreign)\s+key.*?\(([^)]*)\)", part):
                yield "key", table, at, {"kind": key[1].lower(), "columns": [c.strip(" `\"") for c in key[2].split(",")]}, "high"
            elif col := re.match(r"[`\"]?(\w+)[`\"]?\s+(\w+(?:\s*\([^)]*\))?)(.*)", part, re.S):
                rest = col[3].lower()
                yield "column", f"{table}.{col[1]}", at, {"type": col[2].lower(), "nullable": "not null" not in rest and "primary key" not in rest, "primary": "primary key" in rest}, "high"


def text_facts(text: str) -> Iterator[Fact]:
    for n, line in enumerate(text.splitlines(), 1):
        if line.strip():
            yield "line", "", n, line.strip(), "low"


def docx_facts(content: bytes) -> Iterator[Fact]:
    """Headings and paragraphs of a Word file."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    for n, p in enumerate(body.iter(f"{w}p"), 1):
        text = "".join(x.text or "" for x in p.iter(f"{w}t"))
        style = p.find(f"{w}pPr/{w}pStyle")
        if text.strip():
            heading = style is not None and style.get(f"{w}val", "").lower().startswith("heading")
            yield ("heading" if heading else "paragraph"), text if heading else "", n, "" if heading else text, "high"


def xlsx_facts(content: bytes) -> Iterator[Fact]:
    """Cells of each sheet as stored; formulas are not computed."""
    s = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in x.iter(f"{s}t")) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{s}si")]
        sheets = [x.get("name") for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{s}sheet")]
        files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for sheet, file in zip(sheets, files):
            for cell in ElementTree.fromstring(z.read(file)).iter(f"{s}c"):
                v = cell.find(f"{s}v")
                text = "".join(t.text or "" for t in cell.iter(f"{s}t")) if cell.get("t") == "inlineStr" else (v.text if v is not None else None)
                if text is not None:
                    value = shared[int(text)] if cell.get("t") == "s" else text
                    bad = cell.get("t") == "e"
                    yield ("error_cell" if bad else "cell"), f"{sheet}!{cell.get('r')}", int(re.sub(r"\D", "", cell.get("r") or "0") or 0), value, "low" if bad else "high"


BINARY: dict[str, Callable[[bytes], Iterator[Fact]]] = {"docx": docx_facts, "xlsx": xlsx_facts}
PARSERS: dict[str, Callable[[str], Iterator[Fact]]] = {
    "json": json_facts, "jsonld": json_facts, "jsonl": jsonl_facts, "ndjson": jsonl_facts, "csv": csv_facts, "tsv": csv_facts, "ini": ini_facts, "cfg": ini_facts,
    "properties": properties_facts, "toml": toml_facts, "yaml": yaml_facts, "yml": yaml_facts, "md": markdown_facts, "sql": ddl_facts, "txt": text_facts,
}


def parsed(path: str, content: bytes) -> Iterator[tuple]:
    """Facts of one file by its suffix, one after another; unknown suffixes are read as lines, and a file that fails says so in a last fact."""
    suffix = path.rpartition(".")[2].lower()
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    try:
        for kind, name, line, data, quality in BINARY[suffix](content) if suffix in BINARY else PARSERS.get(suffix, text_facts)(text):
            yield path, kind, name, line, json.dumps(data, ensure_ascii=False, sort_keys=True), quality
    except Exception as e:  # noqa: BLE001  one bad file is one failure fact, not the end of the scan
        yield path, "failure", type(e).__name__, 0, json.dumps(str(e)[:200]), "low"


def parse(path: str, content: bytes) -> list[tuple]:
    return list(parsed(path, content))


def facts(files: DataFrame) -> DataFrame:
    """Facts of ``files`` (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = (r for path, content in zip(batch["path"], batch["content"]) for r in parsed(path, bytes(content)))
            for some in batched(rows, FACTS_AT_ONCE):
                yield pd.DataFrame(some, columns=["path", "kind", "name", "line", "data", "quality"])

    return files.select("path", "content").mapInPandas(run, FACT)


def read(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return facts(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder))


def json_leaves(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, value of a flat JSON object's members, without Python."""
    return df.select(F.col(key), F.explode(F.from_json(column, "map<string,string>")).alias("path", "value"))


def csv_profile(df: DataFrame) -> DataFrame:
    """Per column of a table read as text: non_empty, type and least sample; one pass over the rows."""
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns])
    v = F.col("v")
    all_match = lambda p: F.bool_and(v.rlike(p))
    kind = F.when(F.count(F.lit(1)) == 0, "empty").when(all_match(r"^[+-]?\d+$"), "integer").when(all_match(r"^[+-]?\d*\.?\d+([eE][+-]?\d+)?$"), "number").otherwise("text")
    return df.select(F.inline(parts)).filter("v IS NOT NULL AND trim(v) <> ''").groupBy("column").agg(F.count(F.lit(1)).alias("non_empty"), kind.alias("type"), F.min("v").alias("sample"))
