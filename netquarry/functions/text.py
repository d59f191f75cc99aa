"""Text functions as column expressions; Python only where nesting or byte errors need it."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip_think(text: Column) -> Column:
    """The text without its thought blocks, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"\s+", " "))


def think_text(text: Column) -> Column:
    """The first closed thought block, trimmed; the text as it is if it has none; nothing for null and blank texts."""
    block = r"(?s)<think>(.*?)</think>"
    inner = F.regexp_replace(F.regexp_extract(text, block, 1), r"^\s+|\s+$", "")
    return F.when(F.coalesce(text, F.lit("")).rlike(r"^\s*$"), "").when(text.rlike(block), inner).otherwise(text)


#: The tag before a score, and the word that a looser search looks for.
SCORE_TAG, SCORE_WORD = "【置信度】", "置信度"


def confidence(text: Column, tag: str = SCORE_TAG, word: str = SCORE_WORD) -> Column:
    """The number after the tag and a colon, else the first number after the word, else -1."""
    number = r"([0-9]*\.?[0-9]+)"
    strict = F.regexp_extract(text, rf"{tag}[：:]\s*{number}", 1)
    loose = F.regexp_extract(text, rf"{word}.*?{number}", 1)
    return F.coalesce(F.nullif(strict, F.lit("")).try_cast("double"), F.nullif(loose, F.lit("")).try_cast("double"), F.lit(-1.0))


def byte_position(data: Column, pattern: bytes) -> Column:
    """1-based place of the first byte where the pattern begins in binary data, 0 if it is nowhere."""
    return F.instr(F.decode(data, "ISO-8859-1"), pattern.decode("iso-8859-1")).cast("long")


def report_arguments(text: Column) -> Column:
    """(flag, start, duration) of a report call in text, in JSON, keyword or tag form; no flag is false, no number null."""
    number = lambda name: F.regexp_extract(text, name + r"""["']?(?:>|\s*[:=])\s*(-?\d+)""", 1).try_cast("int")
    flag = F.regexp_extract(text, r"""(?i)is_suspicious["']?(?:>|\s*[:=])\s*(true|false)""", 1)
    return F.struct(
        F.coalesce(F.lower(flag) == "true", F.lit(False)).alias("flag"), number("suspicious_flows_start").alias("start"), number("suspicious_flows_duration").alias("duration")
    )


def resolved(value: Column, context: Column) -> Column:
    """What a `$name` stands for in a map of names, '' if nothing; any other value as it is."""
    found = F.try_element_at(context, F.substr(value, F.lit(2)))
    return F.when(F.startswith(value, F.lit("$")), F.coalesce(found, F.lit(""))).otherwise(value)


def expected(rule: Column, value: Column, about: float = 3) -> Column:
    """Whether a number is as a rule in text says: `[a, b]` in the range, `≈ n` within `about` of it, `> n` above it. Other rules
    and null fail."""
    num = lambda p, g=1: F.regexp_extract(rule, p, g).try_cast("double")
    span = r"^\[\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)\s*\]$"
    ok = F.when(rule.rlike(span), value.between(num(span), num(span, 2)))
    ok = ok.when(rule.rlike(r"^≈"), F.abs(value - num(r"≈\s*([\d.]+)")) <= about).when(rule.rlike(r"^>"), value > num(r">\s*([\d.]+)"))
    return F.coalesce(ok, F.lit(False))


def foreign_names(names: Column, allowed: list[str]) -> Column:
    """Whether some name has no allowed domain as a part of it; no for no names."""
    known = F.array(*map(F.lit, allowed)) if allowed else F.array().cast("array<string>")
    return F.coalesce(F.exists(names, lambda n: ~F.exists(known, lambda a: F.contains(n, a))), F.lit(False))


def last_code_block(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?s)```(?:\w+)?\n(.*?)```"), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def normal_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    out = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\b(a|an|the)\b", " "), r"\s+", " "))


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: t != "")


def shared_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.array_distinct(F.array_intersect(a, b))
    return F.aggregate(both, F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the tokens of normal answers; if either is yes, no or noanswer they must be equal."""
    closed = F.array(F.lit("yes"), F.lit("no"), F.lit("noanswer"))
    a, b = tokens(prediction), tokens(gold)
    n = shared_tokens(a, b)
    f1 = F.when(n == 0, 0.0).otherwise(2.0 * n / (F.size(a) + F.size(b)))
    strict = F.array_contains(closed, prediction) | F.array_contains(closed, gold)
    return F.when(strict & (prediction != gold), 0.0).otherwise(f1)


@F.pandas_udf(T.StructType().add("f1", T.DoubleType()).add("exact", T.BooleanType()))
def best_of_golds(predictions: pd.Series, golds: pd.Series) -> pd.DataFrame:
    """Best F1 of a normal answer over its golds (as token_f1), and whether it equals any; in time linear in the texts."""
    closed = {"yes", "no", "noanswer"}
    known: dict[tuple, list] = {}  # a list of golds serves many predictions

    def counted(s: str) -> tuple[Counter, int]:
        c = Counter(s.split(" "))
        del c[""]
        return c, c.total()

    def one(p, gs):
        if gs not in known:
            if len(known) > 1000:
                known.clear()
            known[gs] = [(g, *counted(g)) for g in gs]
        a, size = counted(p)
        best = 0.0
        for g, b, n in known[gs]:
            small, large = (a, b) if len(a) < len(b) else (b, a)
            shared = 0 if p != g and (p in closed or g in closed) else sum(min(x, large[t]) for t, x in small.items() if t in large)
            if shared:
                best = max(best, 2.0 * shared / (size + n))
        return best, p in gs

    return pd.DataFrame([one(p or "", tuple(gs)) for p, gs in zip(predictions, golds, strict=True)], columns=["f1", "exact"])


def one_tag(text: Column, tag: str) -> Column:
    """The content of the only <tag> element; null if there is none or more than one."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), 1)
    return F.when(F.size(found) == 1, F.trim(found[0]))


#: Patterns of a mathematical answer.
MATH = [
    r"^[+-]?\d+$",
    r"^[+-]?\d*\.\d+$",
    r"^[+-]?\d+/\d+$",
    r"\\boxed\{.*\}",
    r"\\[dtf]?frac\{.*\}\{.*\}",
    r"^\$.*\$$",
    r"[+\-*/=<>≤≥≠∫∑∏]",
    r"^[+-]?\d*\.?\d+[eE][+-]?\d+$",
    r"[a-zA-Z]\s*[\^+\-*/]|[\^+\-*/]\s*[a-zA-Z]",
]


def answer_kind(text: Column) -> Column:
    """yesno, bool, math or text."""
    t = F.trim(text)
    sums = F.lit(False)
    for pattern in MATH:
        sums = sums | t.rlike(pattern)
    closed = lambda *words: F.lower(t).isin(*words)
    return F.when(closed("yes", "no"), "yesno").when(closed("true", "false"), "bool").when(sums, "math").otherwise("text")


def search_words(text: Column) -> Column:
    """Lower-case words for retrieval: runs of letters, digits and marks, each Han character by itself; one marker word for
    a text that has none."""
    apart = F.regexp_replace(F.lower(text), r"(\p{IsHan})", " $1 ")
    found = F.regexp_extract_all(apart, F.lit(r"[\p{L}\p{N}\p{M}_]+"), 0)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("__empty__")))


def printable(hex_text: Column) -> Column:
    """Hex as ASCII, a dot for bytes that aren't printable, ? where it is no hex."""
    return F.coalesce(F.regexp_replace(F.decode(F.try_to_binary(hex_text, F.lit("hex")), "ISO-8859-1"), r"[^\x20-\x7e]", "."), F.lit("?"))


def hex_to_text(hex_text: Column | str) -> Column:
    """Hex as UTF-8; bad bytes as \\xNN, and a marker for text that is no hex. Only what isn't plain hex of UTF-8 goes to Python."""
    hex_text = F.col(hex_text) if isinstance(hex_text, str) else hex_text
    data = F.when(F.char_length(hex_text) % 2 == 0, F.try_to_binary(hex_text, F.lit("hex"))).cast("string")
    plain = F.when(F.is_valid_utf8(data), data)
    return F.coalesce(plain, _escaped_hex(F.when(plain.isNull(), hex_text)))


@F.pandas_udf(T.StringType())
def _escaped_hex(values: pd.Series) -> pd.Series:
    """Hex as UTF-8; bad bytes as \\xNN, and a marker for text that is no hex."""

    def one(value):
        if value is None:
            return None
        try:
            return bytes.fromhex(value).decode("utf-8", "backslashreplace")
        except ValueError:
            return f"<DECODE_ERROR: {value}>"

    return values.map(one)


def _braced(value: str, begin: int) -> str | None:
    """From `begin` to the brace that closes the one before it; None if it stays open."""
    depth = 1
    for k in range(begin, len(value)):
        depth += {"{": 1, "}": -1}.get(value[k], 0)
        if not depth:
            return value[begin:k]
    return None


@F.pandas_udf(T.StringType())
def last_boxed(values: pd.Series) -> pd.Series:
    """Content of the last \\boxed{...}, braces balanced; null if there is none."""
    return values.map(lambda v: _braced(v, at + 7) if (at := (v or "").rfind("\\boxed{")) >= 0 else None)


@F.pandas_udf(T.StringType())
def first_boxed(values: pd.Series) -> pd.Series:
    """Content of the first boxed{...}, with or without a backslash; null if there is none or it stays open."""
    return values.map(lambda v: _braced(v, at + 6) if (at := (v or "").find("boxed{")) >= 0 else None)
