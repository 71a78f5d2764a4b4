"""Chat formatting with a checked round trip, in DataFrame functions only.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. A conversation is
first written with its texts as they are and read back by a strict parser. If
the parser refuses it, or recovers other turns than the source has, its texts
are escaped and it is written again; the level that read back identically is
kept in ``escape_level``.

Escaping puts one backslash between ``<`` (and any backslashes after it) and
``|``, so no ``<|`` is left in a text, and reading takes one backslash out
again. In roles, ``%`` and line feeds are percent-coded first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _role(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_back(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(turns: Column, level: int) -> Column:
    """turns: array<struct<role, text>>, no nulls inside. Level 0 writes texts as they are."""
    own = escape if level else lambda c: c
    one = lambda t: F.concat(F.lit(START), escape(_role(t["role"])), F.lit("\n"), own(t["text"]), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation, texts unescaped; null if it breaks the grammar.

    Grammar: any number of START role LF text END LF, where role and text hold no ``<|`` and role no line feed.
    """
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    body = lambda p: F.substr(p, F.lit(1), F.length(p) - F.lit(len(END) + 1))
    good = lambda p: p.endswith(END + "\n") & ~body(p).contains("<|") & body(p).contains("\n")
    turn = lambda p: F.struct(
        _role_back(unescape(F.substring_index(body(p), "\n", 1))).alias("role"),
        unescape(F.substr(body(p), F.instr(body(p), "\n") + F.lit(1))).alias("text"),
    )
    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.when((F.element_at(pieces, 1) == "") & F.forall(rest, good), F.transform(rest, turn))


def text_spans(formatted: Column, role: str) -> Column:
    """array<struct<start, length>> in code points, from 0, of the texts of ``role`` in a rendered conversation: the loss mask."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    head = lambda p: F.substring_index(p, "\n", 1)
    none = F.lit(None).cast("array<struct<start:int,length:int>>")
    step = lambda acc, p: F.struct(
        (acc["at"] + F.lit(len(START)) + F.length(p)).cast("int").alias("at"),
        F.when(
            head(p) == F.lit(role),
            F.concat(
                acc["spans"],
                F.array(
                    F.struct(
                        (acc["at"] + F.lit(len(START)) + F.length(head(p)) + 1).cast("int").alias("start"),
                        (F.length(p) - F.length(head(p)) - F.lit(1 + len(END) + 1)).cast("int").alias("length"),
                    )
                ),
            ),
        )
        .otherwise(acc["spans"])
        .alias("spans"),
    )
    zero = F.struct(F.lit(0).cast("int").alias("at"), F.coalesce(none, F.array().cast("array<struct<start:int,length:int>>")).alias("spans"))
    return F.aggregate(rest, zero, step, lambda acc: acc["spans"])


def formatted(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, escape_level.

    * Turns are taken by turn number; ties and repeated rows all stay, ordered by role and text; a null turn comes first.
    * Null roles and texts count as empty. Rows with a null conversation form one conversation.
    * An empty table gives an empty result; other columns are ignored.
    * The loss mask covers each text of role ``assistant``, as escaped in the output.
    * A conversation that reads back wrongly at every level is an error, never a silent loss.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("row"),
    )
    source = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("row")), lambda r: F.struct(r["role"], r["text"])).alias("turns"))
    plain = source.withColumn("plain", render(F.col("turns"), 0)).withColumn("level", F.when(parse(F.col("plain")).eqNullSafe(F.col("turns")), 0).otherwise(1))
    out = plain.withColumn("formatted", F.when(F.col("level") == 0, F.col("plain")).otherwise(render(F.col("turns"), 1)))
    good = F.when(F.col("level") == 0, F.lit(True)).otherwise(parse(F.col("formatted")).eqNullSafe(F.col("turns")))
    checked = F.when(good, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not read back as it was")))
    return out.select("conv_id", checked.alias("formatted"), F.col("level").alias("escape_level")).withColumn("loss_spans", text_spans(F.col("formatted"), "assistant"))


def read_back(output: DataFrame) -> DataFrame:
    """Digests of what the formatted column itself holds: turns by the parser, loss text by the mask's spans."""
    turns = parse(F.col("formatted"))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return (
        output.withColumns({"_turns": turns, "_loss": F.array_join(loss, "")})
        .select(
            "conv_id",
            F.size("_turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "escape_level",
        )
    )
