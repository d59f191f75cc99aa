"""Training sequences from an agent's steps: steps merged where one goes on from the other, shifted, padded and masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(steps: DataFrame, by: str, order: str, prompt: str, response: str, logprobs: str, advantage: str) -> DataFrame:
    """(by, sequence, steps, tokens, logprobs, advantages, mask): one row for each run of steps of which each prompt begins with
    all tokens before it.

    After a step the tokens so far are its prompt and its response, whether it went on or began anew. So a look at the step
    before tells whether a step goes on, and a running sum numbers the sequences: no state is folded. A step adds what its
    prompt has beyond the tokens so far (mask, log-probability and advantage 0) and its response (mask 1).

    Null arrays are empty. Steps of equal order come in any order. A step whose log-probabilities aren't as many as its
    response's tokens, or hold a null, is an error. A sequence is one row, as the result asks for."""
    none, whole = F.array().cast("array<int>"), F.array().cast("array<double>")
    rows = steps.select(
        by, F.col(order).alias("_order"), F.coalesce(F.col(prompt).cast("array<int>"), none).alias("_prompt"),
        F.coalesce(F.col(response).cast("array<int>"), none).alias("_response"),
        F.coalesce(F.col(logprobs).cast("array<double>"), whole).alias("_logprobs"), F.col(advantage).cast("double").alias("_advantage"),
    )
    good = (F.size("_logprobs") == F.size("_response")) & ~F.exists("_logprobs", lambda x: x.isNull())
    wrong = F.raise_error(F.lit("a step's log-probabilities don't fit its response")).cast("array<double>")
    rows = rows.withColumn("_logprobs", F.when(good, F.col("_logprobs")).otherwise(wrong))
    w = Window.partitionBy(by).orderBy("_order")
    rows = rows.withColumn("_before", F.lag(F.concat("_prompt", "_response")).over(w))
    n = F.size("_before")
    goes_on = F.coalesce(F.slice("_prompt", F.lit(1), F.greatest(n, F.lit(0))) == F.col("_before"), F.lit(False))
    rows = rows.withColumn("_skip", F.when(goes_on, n).otherwise(0)).withColumn("_new", F.when(goes_on, 0).otherwise(1))
    rows = rows.withColumn("sequence", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    m, k = F.size("_prompt") - F.col("_skip"), F.size("_response")
    flat = lambda value: F.concat(F.array_repeat(F.lit(0.0), m), value)
    part = F.struct(
        F.col("_order").alias("order"), F.concat(F.slice("_prompt", F.col("_skip") + 1, m), "_response").alias("tokens"), flat(F.col("_logprobs")).alias("logprobs"),
        flat(F.array_repeat("_advantage", k)).alias("advantages"), F.concat(F.array_repeat(F.lit(0), m), F.array_repeat(F.lit(1), k)).alias("mask"),
    )
    out = rows.groupBy(by, "sequence").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    joined = lambda name: F.flatten(F.transform("_parts", lambda p: p[name])).alias(name)
    return out.select(by, "sequence", F.size("_parts").alias("steps"), *map(joined, ("tokens", "logprobs", "advantages", "mask")))


def shifted(sequences: DataFrame) -> DataFrame:
    """Input and target tokens, one place apart, and the other columns as they fit the targets. A sequence of no tokens has
    empty arrays."""
    n = F.greatest(F.size("tokens") - 1, F.lit(0))
    tail = lambda c: F.slice(c, F.lit(2), n)
    return sequences.withColumns(
        {"input_tokens": F.slice("tokens", F.lit(1), n), "target_tokens": tail("tokens"), "logprobs": tail("logprobs"), "advantages": tail("advantages"), "mask": tail("mask")}
    ).drop("tokens")


def pad_left(array: Column, size: int, value) -> Column:
    """The last `size` entries, filled up in front."""
    kept = F.slice(array, F.greatest(F.size(array) - size, F.lit(0)) + 1, F.lit(size))
    return F.concat(F.array_repeat(F.lit(value), size - F.size(kept)), kept)


def pad_right(array: Column, size: int, value) -> Column:
    """The first `size` entries, filled up behind."""
    kept = F.slice(array, 1, size)
    return F.concat(kept, F.array_repeat(F.lit(value), size - F.size(kept)))


def attention(prompt: Column, response: Column, max_prompt: int, max_response: int) -> Column:
    """1 for the places of a padded prompt and response that hold a token."""
    ones = lambda a, n: F.array_repeat(F.lit(1), F.least(F.size(a), F.lit(n)))
    return F.concat(pad_left(ones(prompt, max_prompt), max_prompt, 0), pad_right(ones(response, max_response), max_response, 0))


def positions(mask: Column) -> Column:
    """Number of each place that the mask has, from 0; 0 elsewhere."""
    return F.transform(mask, lambda x, i: (F.aggregate(F.slice(mask, 1, i + 1), F.lit(0), lambda s, y: s + y) - 1) * x)


def at_last(response: Column, size: int, reward: Column) -> Column:
    """The reward at the last token of a padded response, 0 elsewhere; nowhere for an empty one or one that was cut."""
    n = F.size(response)
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.when(i == n, reward).otherwise(0.0))
