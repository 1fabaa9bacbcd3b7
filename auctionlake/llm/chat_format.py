"""Chat formatting with a grammar that is read back: DataFrame functions only.

A conversation becomes ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. The parser has no choices: a
turn is a start mark, a role without marks up to the first line feed, a text up to the first end mark, and
one line feed; anything else is no turn. A turn that does not come back as it went in is escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """One more backslash inside every ``<|``, ``<\\|``, ``<\\\\|`` ...: no mark is left, and nothing else changes."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role is a line: percent signs and line feeds are written as %25 and %0A, marks as in texts."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """The turns (role, text, raw_role, raw_text) that a formatted text holds: as meant, and as they stand there.

    What is no turn by the grammar, text before the first start mark included, gives a turn of nulls.
    """
    pieces = F.split(formatted, r"<\|im_start\|>")

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        role, body = F.substring(piece, F.lit(1), cut - 1), F.substring(piece, cut + 1, F.length(piece))
        stop = F.instr(body, END)
        good = (cut > 0) & (stop > 0) & (F.instr(role, END) == 0) & (F.substring(body, stop + len(END), F.length(body)) == "\n")
        text = F.substring(body, F.lit(1), stop - 1)
        whole = F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"), role.alias("raw_role"), text.alias("raw_text"))
        nothing = F.lit(None).cast("string")
        return F.when(good, whole).otherwise(F.struct(*(nothing.alias(c) for c in ("role", "text", "raw_role", "raw_text"))))

    found = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
    return F.when(F.element_at(pieces, 1) == "", found).otherwise(F.concat(F.transform(F.slice(pieces, 1, 1), turn), found))


def _turns(parsed: Column) -> Column:
    return F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _segments(parsed: Column) -> Column:
    """The pieces of a formatted text as the parser found them, with what counts towards the loss marked."""

    def parts(t: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(START), t["raw_role"], F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(t["raw_text"].alias("text"), (t["role"] == "assistant").alias("loss")),
            F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
        )

    return F.flatten(F.transform(parsed, parts))


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, n_turns, formatted, segments, turns, escapes, exact), one row for each conversation.

    ``turns`` and ``segments`` are what the parser reads out of ``formatted``: its turns, and its pieces with a
    loss mask over assistant texts. ``escapes`` counts the turns that had to be escaped. A conversation whose
    turns did not come back after that would raise an error; ``exact`` is true wherever there is a row.
    Turns go by number, rows of one number by role and text; null texts and roles are empty, null numbers
    come first, and a null conversation id is one conversation. Repeated rows are repeated turns. An empty
    table gives no rows; other columns are not read. A conversation's turns meet in one row, as its text must.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    source = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    # Marks share no ends, so a turn that comes back alone comes back among others.
    alone = _turns(parse(_render(F.col("role"), F.col("text"))))
    tried = source.withColumn("plain", alone == F.array(F.struct("role", "text")))
    raw_role = F.when(F.col("plain"), F.col("role")).otherwise(escape_role(F.col("role")))
    raw_text = F.when(F.col("plain"), F.col("text")).otherwise(escape(F.col("text")))
    turns = tried.select("conv", F.struct("turn", "role", "text", _render(raw_role, raw_text).alias("written"), F.col("plain").alias("plain")).alias("t"))
    d = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    d = d.select(
        "conv",
        F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.array_join(F.transform("ts", lambda t: t["written"]), "").alias("formatted"),
        F.size(F.filter("ts", lambda t: ~t["plain"])).alias("escapes"),
    ).withColumn("parsed", parse(F.col("formatted")))
    exact = F.when(F.coalesce(_turns(F.col("parsed")) == F.col("source"), F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a conversation did not come back as it went in")).cast("boolean"))
    return d.select(F.col("conv").alias(conv_col), F.size("parsed").cast("long").alias("n_turns"), "formatted", _segments(F.col("parsed")).alias("segments"), _turns(F.col("parsed")).alias("turns"), "escapes", exact.alias("exact"))


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of the turns read back, and of what the loss mask covers, unescaped."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.withColumn("loss_text", loss).select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "exact",
    )
