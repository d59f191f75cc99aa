"""Chat conversations as one marked text each, proved by parsing it again; in DataFrame functions only.

A formatted conversation is a sequence of turns, each written as

    user             [INST] text [/INST]
    assistant        text</s>
    any other role   [ROLE name] text [/ROLE]

and may be read by a deterministic parser: at each place the opening mark decides (none: assistant), a turn ends at its
first closing mark, and a text that holds a control string is no text. Between `[` or `<` and the rest of a control
string, an escaped text has one backslash more than the text: `[INST]` becomes `[\\INST]`, `[\\INST]` becomes
`[\\\\INST]`. The parser takes one away, so both ways are exact and other texts are their own escaped form.

A conversation is first written as it is and parsed. Turns that don't come back (because their text holds a control
string, looks escaped, or shifted the turns behind it) are escaped and the result is parsed again; then all turns. What
still differs would be an error, never a silent loss.

The loss mask is a list of byte ranges: the texts of assistant turns, without marks. `loss_text` reads them.

A conversation is one row of the result and so one task's work, whatever its length. Rows are ordered by turn (null
first), equal turns by role and text; repeated rows are turns of their own. Null role and null text count as empty, null
identifiers are one conversation. Role names are written with `%` and `]` as %25 and %5D. An empty table gives no row.
Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What follows `[` or `<` and any number of backslashes in a control string.
_SQUARE, _ANGLE = r"(/?INST\]|ROLE |/ROLE\])", r"(/?s>)"
_TURN = r"(?s)\G(?:\[INST\] .*? \[/INST\]|\[ROLE [^\]]*\] .*? \[/ROLE\]|.*?</s>)"


def escaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"(\[\\*)" + _SQUARE, r"$1\\$2")
    return F.regexp_replace(text, r"(<\\*)" + _ANGLE, r"$1\\$2")


def unescaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"(\[\\*)\\" + _SQUARE, "$1$2")
    return F.regexp_replace(text, r"(<\\*)\\" + _ANGLE, "$1$2")


def _marked(role: Column, text: Column) -> Column:
    name = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("]"), F.lit("%5D"))
    other = F.concat(F.lit("[ROLE "), name, F.lit("] "), text, F.lit(" [/ROLE]"))
    user = F.concat(F.lit("[INST] "), text, F.lit(" [/INST]"))
    return F.when(role == "user", user).when(role == "assistant", F.concat(text, F.lit("</s>"))).otherwise(other)


def _written(source: str, protect) -> Column:
    """The turns as one text; protect(i) tells whether turn i is escaped."""
    turns = F.transform(source, lambda t, i: _marked(t["role"], F.when(protect(i), escaped(t["text"])).otherwise(t["text"])))
    return F.array_join(turns, "")


def _is_assistant(piece: Column) -> Column:
    return F.endswith(piece, F.lit("</s>"))


def _read(piece: Column) -> Column:
    """(role, text) of a marked turn; the text is null if it holds a control string."""
    name = F.regexp_extract(piece, r"^\[ROLE ([^\]]*)\] ", 1)
    n, plain = F.char_length(piece), F.endswith(piece, F.lit(" [/INST]")) & F.startswith(piece, F.lit("[INST] "))
    text = (
        F.when(_is_assistant(piece), F.substr(piece, F.lit(1), n - 4))
        .when(plain, F.substr(piece, F.lit(8), n - 15))
        .otherwise(F.substr(piece, F.char_length(name) + 9, n - F.char_length(name) - 16))
    )
    role = F.when(_is_assistant(piece), "assistant").when(plain, "user").otherwise(
        F.replace(F.replace(name, F.lit("%5D"), F.lit("]")), F.lit("%25"), F.lit("%"))
    )
    free = ~F.rlike(text, F.lit(rf"\[{_SQUARE}|<{_ANGLE}"))
    return F.struct(role.alias("role"), F.when(free, unescaped(text)).alias("text"))


def parsed(text: Column | str) -> Column:
    """The marked turns of a formatted text, as they stand there; null if the parser doesn't get through to its end."""
    pieces = F.regexp_extract_all(text, F.lit(_TURN), F.lit(0))
    reached = F.aggregate(pieces, F.lit(0), lambda n, p: n + F.octet_length(p))
    return F.when(reached == F.octet_length(text), pieces)


def _spans(pieces: str) -> Column:
    """Byte ranges [start, end) of the assistant texts."""
    kind = "array<struct<start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        size = F.octet_length(piece)
        span = F.struct(state["at"].alias("start"), (state["at"] + size - 4).alias("end"))
        spans = F.when(_is_assistant(piece), F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + size).alias("at"), spans.cast(kind).alias("spans"))

    return F.aggregate(pieces, start, step, lambda state: state["spans"])


def loss_text(formatted: str, spans: str) -> Column:
    """All text under the loss mask, without escapes."""
    inside = lambda s: F.substr(F.col(formatted).cast("binary"), s["start"] + 1, s["end"] - s["start"]).cast("string")
    return F.array_join(F.transform(spans, lambda s: unescaped(inside(s))), "")


def formatted(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: identifier, formatted, turns (role, text) as parsed from it, loss_spans."""
    empty = F.lit("")
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(role_col, empty).alias("role"), F.coalesce(text_col, empty).alias("text")
    )
    df = rows.groupBy(F.col(id_col).alias("_id")).agg(F.array_sort(F.collect_list(turn)).alias("_given"))
    df = df.select("_id", F.transform("_given", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("_source"))

    same = F.coalesce(F.col("_turns") == F.col("_source"), F.lit(False))
    differs = lambda i: ~F.coalesce(F.get("_turns", i) == F.get("_source", i), F.lit(False))
    attempts = [lambda i: F.lit(False), differs, lambda i: F.lit(True)]
    df = df.withColumns({"_same": F.lit(False), "_text": F.lit(""), "_turns": F.lit(None).cast(df.schema["_source"].dataType)})
    for protect in attempts:
        df = df.withColumn("_text", F.when(F.col("_same"), F.col("_text")).otherwise(_written("_source", protect)))
        df = df.withColumn("_pieces", parsed(F.col("_text")))
        df = df.withColumn("_turns", F.transform("_pieces", _read)).withColumn("_same", same)
    proved = F.when(F.col("_same"), F.col("_text")).otherwise(F.raise_error(F.lit("a conversation can't be read back")).cast("string"))
    return df.select(F.col("_id").alias(id_col), proved.alias("formatted"), F.col("_turns").alias("turns"), _spans("_pieces").alias("loss_spans"))
