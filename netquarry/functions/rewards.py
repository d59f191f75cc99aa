"""Answer checking: extraction cascades, mathematical normal forms, equations, dispatch by kind of answer."""

from __future__ import annotations

import operator
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquarry.functions.text import answer_kind, first_boxed, normal_answer, strip_think, token_f1

_OPS = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}
RIGHT_AT = 0.3  # token F1 from which a text answer counts as right


_TOKEN = re.compile(r"\s*(?:(\d+)|([-+*/()]))")
_RANK = {"+": 1, "-": 1, "*": 2, "/": 2, "sign": 3}


def value_of(expression: str) -> Fraction | None:
    """Exact value of + - * / over whole numbers and brackets, however long or nested; None for anything else."""
    values: list[Fraction] = []
    waiting: list[str] = []

    def settle(rank: int) -> None:
        while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= rank:
            op, right = waiting.pop(), values.pop()
            values.append(-right if op == "sign" else _OPS[op](values.pop(), right))

    at, operand, text = 0, False, expression.strip()
    try:
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                return None
            at = found.end()
            number, sign = found.groups()
            if number:
                if operand or len(number) > 1 and number[0] == "0" and number.strip("0"):
                    return None
                values.append(Fraction(int(number)))
                operand = True
            elif sign == "(" and not operand:
                waiting.append("(")
            elif sign == ")" and operand:
                settle(1)
                if not waiting:
                    return None
                waiting.pop()
            elif sign == "-" and not operand:
                waiting.append("sign")
            elif sign in _OPS and operand:
                settle(_RANK[sign])
                waiting.append(sign)
                operand = False
            else:
                return None
        if not operand or "(" in waiting:
            return None
        settle(1)
        return values[0]
    except (ZeroDivisionError, ValueError):
        return None


def countdown_equation(solution: Column) -> Column:
    """The last answer in what follows the assistant's mark, if there is one; null without an answer."""
    after = lambda mark: F.substring(solution, F.instr(solution, mark) + len(mark), F.length(solution))
    marks = ("Assistant:", "<|im_start|>assistant")
    said = F.when(F.contains(solution, F.lit(marks[0])), after(marks[0])).when(F.contains(solution, F.lit(marks[1])), after(marks[1])).otherwise(solution)
    found = F.regexp_extract_all(said, F.lit(r"<answer>(.*?)</answer>"), 1)
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


@F.pandas_udf(T.DoubleType())
def countdown_reward(equation: pd.Series, numbers: pd.Series, target: pd.Series) -> pd.Series:
    """1 if the equation uses each number once and gives the target, 0.1 for any other equation, 0 for none."""

    def one(text, nums, goal):
        if text is None or nums is None or goal is None:
            return 0.0
        used = sorted(int(x) for x in re.findall(r"\d+", text))
        value = value_of(text) if used == sorted(int(x) for x in nums) else None
        return 1.0 if value is not None and abs(value - int(goal)) < Fraction(1, 10**5) else 0.1

    return pd.Series([one(*x) for x in zip(equation, numbers, target, strict=True)])


def math_normal(text: Column) -> Column:
    """String normal form of a mathematical answer: no spacing, units, text and degree marks; a/b for fractions."""
    out = F.regexp_replace(text, r"\\(left|right|!|,|;|quad|displaystyle)", "")
    out = F.regexp_replace(out, r"\\(dfrac|tfrac)", r"\\frac")
    out = F.regexp_replace(out, r"\\text\{[^{}]*\}|\^\{?\\circ\}?|\\%|%|\\\$|\$", "")
    out = F.regexp_replace(out, r"\\frac\{?(\w+)\}?\{(\w+)\}", "$1/$2")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+", ""), r"^(\w)=", "")
    return F.regexp_replace(F.regexp_replace(out, r"(\.\d*?)0+$", "$1"), r"\.$", "")


#: Fixed values of the extraction rules.
BOLD = [r"\*\*([^*]+)\*\*", r"\*([^*]+)\*"]
DATES = [
    r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b",
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b",
    r"\b(?:March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b",
    r"\b\d{4}\b",
]
NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
NOT_NAMES = ["United States", "New York", "Los Angeles", "Great Britain", "Middle East", "South Africa"]
NUMBERS = [
    r"\b(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:votes?|dollars?|years?|months?|days?|people|million|billion|percent|%)\b",
    r"\b(\d+(?:,\d{3})*(?:\.\d+)?)\b",
]
SAID = [
    r"(?:the\s+)?(?:correct\s+)?answer\s+is\s*:?\s*([^.!?]+)",
    r"(?:therefore|thus|so|hence)\s*,?\s*([^.!?]+)",
    r"(?:in\s+conclusion|to\s+summarize|in\s+summary)\s*,?\s*([^.!?]+)",
    r"(?:^|\.\s+)([A-Z][^.!?]*(?:was|is|are|were)\s+[^.!?]+)",
    r"(?:the\s+answer\s+would\s+be|it\s+(?:is|was))\s*:?\s*([^.!?]+)",
]
POINTS = [(r"\b\d{4}\b", 3), (NAME, 2), (r"(?i)\b(?:was|is|are|were)\b", 1)]


def extracted(text: Column) -> Column:
    """An answer by the first rule that finds one, thoughts aside: a box, bold words, a date, a name, a number, what is said
    to be the answer, the sentence that tells most, the first sentence, the first 100 characters."""
    t = strip_think(text)
    found = lambda pattern, group=0: F.regexp_extract_all(t, F.lit(f"(?U){pattern}"), group)
    first = lambda xs: F.try_element_at(xs, F.lit(1))
    telling = lambda xs: F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: (F.length(x) > 2) & x.rlike(r"(?U)\w"))
    names = F.filter(found(NAME), lambda x: ~x.isin(*NOT_NAMES) & (F.size(F.split(x, " ")) <= 4))
    said = [F.regexp_replace(F.regexp_extract(t, f"(?imU){p}", 1), r"(?U)^\W+|\W+$", "") for p in SAID]
    sentences = F.transform(F.split(t, "[.!?]+"), lambda s: F.trim(s))

    def rated(s: Column, i: Column) -> Column:
        points = F.when(F.size(F.split(s, " ")) < 15, 1).otherwise(0)
        for pattern, n in POINTS:
            points = points + F.when(s.rlike(f"(?U){pattern}"), n).otherwise(0)
        return F.struct(points.alias("points"), (-i).alias("place"), s.alias("s"))

    most = F.array_max(F.transform(F.filter(sentences, lambda s: F.length(s) > 10), rated))
    return F.coalesce(
        F.trim(first_boxed(t)), *[first(telling(found(p, 1))) for p in BOLD], *[first(found(f"(?i){p}")) for p in DATES], first(names),
        *[first(found(p, 1)) for p in NUMBERS], *[F.when(F.length(c) > 3, c) for c in said], F.when(most["points"] > 0, most["s"]),
        first(F.filter(sentences, lambda s: F.length(s) > 5)), F.trim(F.substring(t, 1, 100)),
    )


def reward(prediction: Column, gold: Column) -> Column:
    """(kind, reward): the gold word is in it for yes/no and true/false, normal forms for mathematics, token F1 for text."""
    kind = answer_kind(gold)
    named = F.contains(F.lower(prediction), F.lower(F.trim(gold))).cast("double")
    sums = (math_normal(prediction) == math_normal(gold)).cast("double")
    words = token_f1(normal_answer(prediction), normal_answer(gold))
    score = F.when(kind.isin("yesno", "bool"), named).when(kind == "math", sums).otherwise(words)
    return F.struct(kind.alias("kind"), score.alias("reward"), (score >= F.when(kind == "text", RIGHT_AT).otherwise(1.0)).alias("right"))


def _interval_score(s: Column, e: Column, ts: Column, te: Column, labels: Column, partly: float, more: float) -> Column:
    """Score of [s, e] against [ts, te]: equal, before, behind, covering, inside, or partly over it by more + partly * IoU.

    Places outside that a covering interval takes along cost 0.2 where their label is 1, else 1."""
    outside = F.aggregate(
        F.sequence(s, F.greatest(s, e)), F.lit(0.0),
        lambda sum_, i: sum_ + F.when((i >= ts) & (i <= te), 0.0).when(F.get(labels, F.when(i > 0, i - 1).otherwise(-1).cast("int")) == 1, 0.2).otherwise(1.0),
    )
    iou = (F.least(e, te) - F.greatest(s, ts) + 1) / (F.greatest(e, te) - F.least(s, ts) + 1)
    return (
        F.when((s == ts) & (e == te), 1.0)
        .when(e < ts, -0.5 + 0.4 * F.exp(-0.2 * (ts - e)))
        .when(s > te, -0.9 + 0.4 * F.exp(-0.2 * (s - te)))
        .when((s <= ts) & (e >= te), 0.5 + 0.4 * F.exp(-0.2 * outside))
        .when((s >= ts) & (e <= te), 0.1 + 0.4 * F.exp(-0.3 * ((s - ts) + 0.2 * (te - e))))
        .otherwise(more + partly * iou)
    )


def interval_reward(suspicious: Column, start: Column, duration: Column, true_start: Column, true_end: Column, labels: Column) -> Column:
    """Reward of a report (attack or not, first flow, number of flows). Normal traffic: 1 if it says so, else -1. A missed
    attack and a report without valid places earn -1."""
    said = F.coalesce(suspicious, F.lit(False))
    score = _interval_score(start, start + duration - 1, true_start, true_end, labels, 0.8, 0.0)
    valid = F.coalesce((start >= 1) & (duration >= 1), F.lit(False))
    normal = F.when(suspicious.isNotNull() & ~said, 1.0).otherwise(-1.0)
    return F.when(true_start.isNull(), normal).when(~said | ~valid, -1.0).otherwise(score)


def interval_reward_by_end(start: Column, end: Column, true_start: Column, true_end: Column, labels: Column) -> Column:
    """The older reward, of a report by first and last flow; no report is right for normal traffic."""
    score = _interval_score(start, end, true_start, true_end, labels, 0.2, -0.1)
    missing = F.when(true_start.isNull(), 1.0).otherwise(-1.0)
    return F.when(start.isNull() | end.isNull(), missing).when((start > end) | (start < 1) | true_start.isNull(), -1.0).otherwise(score)
