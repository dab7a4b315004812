"""Chat formatting with a grammar round trip, in DataFrame operations only.

A conversation is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn and
read again by a deterministic parser. If the turns that come back differ from the
source, the conversation's roles and texts are escaped and rendered again. The
escape puts one backslash into every ``<|``, ``<\\|``, ``<\\\\|`` … (and writes a line
break in a role as ``<|nl|>``), the parser takes one out, so an escaped text never
holds ``<|`` and the second round always agrees; a last check raises if it does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.llm.common import text_of

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def parse(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>`` of a formatted conversation, null if it breaks the grammar.

    Turns end with the end mark and a line break, start with the start mark, and
    hold no other ``<|`` except the line-break mark of a role.
    """
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        inner = F.substring(part, len(START) + 1, 1 << 30)
        at = F.locate("\n", inner)
        role, body = F.substring(inner, F.lit(1), at - 1), F.substring(inner, at + 1, F.length(inner))
        return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"))

    def valid(part: Column) -> Column:
        inner = F.substring(part, len(START) + 1, 1 << 30)
        role = F.substring_index(inner, "\n", 1)
        body = F.substring(inner, F.length(role) + 1, F.length(inner))
        free = ~F.contains(body, F.lit("<|")) & ~F.contains(F.replace(role, F.lit(BREAK), F.lit("")), F.lit("<|"))
        return F.startswith(part, F.lit(START)) & F.contains(inner, F.lit("\n")) & free

    complete = F.element_at(parts, -1) == ""
    return F.when(complete & F.forall(turns, valid), F.transform(turns, turn))


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learn: str = "assistant",
) -> DataFrame:
    """``(conv_id, formatted, turns, loss_spans)`` per conversation.

    ``turns`` are those read back from ``formatted``; ``loss_spans`` holds the
    code-point spans ``(start, length)``, from 0, of the text of each ``learn`` turn.

    * Null role or text: the empty text. Null conversation id: a conversation of its own.
    * Turns are ordered by turn (nulls first), role and text, so ties and repeated rows have a fixed place.
    * Empty table: empty result. Other columns are ignored, whatever their names.
    * One conversation is one row, so its whole text must fit into one task, as it must into one output value.
    """
    source = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        text_of(F.col(role_col)).alias("role"),
        text_of(F.col(text_col)).alias("text"),
    )
    whole = Window.partitionBy("conv_id").orderBy("turn", "role", "text")

    def rendering(role: Column, text: Column, name: str) -> Column:
        return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END)).alias(name)

    placed = source.select(
        "conv_id",
        "turn",
        F.row_number().over(whole).alias("at"),
        "role",
        "text",
        rendering(F.col("role"), F.col("text"), "plain"),
        rendering(_escape_role(F.col("role")), escape(F.col("text")), "safe"),
        F.length(escape(F.col("text"))).alias("safe_chars"),
    )
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    ends = len(END)

    def start(rendered: str, chars: Column) -> Column:
        return F.coalesce(F.sum(F.length(rendered)).over(before), F.lit(0)) + F.length(rendered) - ends - chars

    positioned = placed.select(
        "*",
        start("plain", F.length("text")).alias("plain_start"),
        start("safe", F.col("safe_chars")).alias("safe_start"),
    )
    gathered = positioned.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(F.struct("at", "role", "text", "plain", "safe", "plain_start", "safe_start", "safe_chars"))
        ).alias("t")
    )
    origin = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    learned = F.filter("t", lambda x: x["role"] == learn)
    tried = gathered.select(
        "conv_id", "t", origin.alias("origin"), learned.alias("learned"), F.array_join("t.plain", "").alias("plain")
    ).withColumn("same", F.coalesce(parse(F.col("plain")) == F.col("origin"), F.lit(False)))
    span = lambda start, length: F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"))
    chosen = tried.select(
        "conv_id",
        "origin",
        F.when(F.col("same"), F.col("plain")).otherwise(F.array_join("t.safe", "")).alias("formatted"),
        F.when(F.col("same"), F.transform("learned", lambda x: span(x["plain_start"], F.length(x["text"]))))
        .otherwise(F.transform("learned", lambda x: span(x["safe_start"], x["safe_chars"])))
        .alias("loss_spans"),
    ).withColumn("turns", parse(F.col("formatted")))
    return chosen.select(
        "conv_id",
        "formatted",
        F.when(F.col("turns") == F.col("origin"), F.col("turns"))
        .otherwise(F.raise_error(F.lit("a conversation differs after its round trip")))
        .alias("turns"),
        "loss_spans",
    )


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(
            loss_spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))
        ),
        "",
    )


def conversation_digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what ``format_conversations`` made, all read back from the formatted text."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
