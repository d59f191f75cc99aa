"""Evaluation of answers and runs: pass rates by file and folder, session lengths, judge and report metrics, contests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.operators.vector_index import VectorIndex


def file_pass(scores: DataFrame, file: str, score: str) -> DataFrame:
    """(file, total, correct, pass_1) of each file: the share of rows whose score is 1; a null score isn't right."""
    right = F.count_if(F.coalesce(F.col(score) == 1, F.lit(False)))
    n = F.count(F.lit(1))
    return scores.groupBy(file).agg(n.alias("total"), right.alias("correct"), (right / n).alias("pass_1"))


def folder_pass(scores: DataFrame, file: str, question: str, score: str) -> DataFrame:
    """One row: samples, correct (questions that some file got right), k (files), pass_k. Of a file's rows with one question the
    largest score counts, a row without a score as 0. Files that don't have the same questions are an error."""
    per = scores.groupBy(question).agg(F.countDistinct(file).alias("files"), F.max(F.coalesce((F.col(score) == 1).cast("int"), F.lit(0))).alias("ok"))
    k = scores.agg(F.countDistinct(file).alias("k")).withColumn("one", F.lit(1))
    totals = per.agg(F.count(F.lit(1)).alias("samples"), F.sum("ok").alias("correct"), F.min("files").alias("least")).withColumn("one", F.lit(1))
    both = totals.join(k, "one")  # single rows
    wrong = F.raise_error(F.lit("the files have different questions")).cast("long")
    samples = F.when(F.coalesce(F.col("least"), F.lit(0)) == F.col("k"), F.col("samples")).otherwise(wrong)
    correct = F.coalesce("correct", F.lit(0)).cast("long")
    rate = F.coalesce(F.try_divide(correct, F.col("samples")), F.lit(0.0))
    return both.select(samples.alias("samples"), correct.alias("correct"), "k", rate.alias("pass_k"))


def session_metrics(steps: DataFrame, session: str, trajectory: str, prompt: str, response: str, times: list[str]) -> DataFrame:
    """Per session: empty, num_trajectories, steps, mean/max/min of response and max/min of prompt lengths (0 without steps), and
    the sum of each of `times` with their total. A session without steps has a row with a null trajectory."""
    there = F.col(trajectory).isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    length = lambda f, c: zero(f(F.when(there, F.col(c))))
    n = F.count_if(there)
    sums = [F.coalesce(F.sum(t), F.lit(0.0)).alias(t) for t in times]
    out = steps.groupBy(session).agg(
        (n == 0).cast("int").alias("empty"), F.countDistinct(trajectory).alias("num_trajectories"), n.alias("steps"), F.coalesce(F.avg(F.when(there, F.col(response))), F.lit(0.0)).alias("mean_response_len"),
        length(F.max, response).alias("max_response_len"), length(F.min, response).alias("min_response_len"), length(F.max, prompt).alias("max_prompt_len"), length(F.min, prompt).alias("min_prompt_len"), *sums,
    )
    total = F.lit(0.0)
    for t in times:
        total = total + F.col(t)
    return out.withColumn("total_time", total) if times else out


def judge_metrics(results: DataFrame, correct: str, rounds: str, reason: str) -> DataFrame:
    """One row: total_questions, judge_correct, judge_accuracy, average_rounds, and the number of results by termination reason
    as a sorted array of (reason, n). Null counts as wrong, as no rounds and as the reason 'unknown'. No result, no row."""
    per = results.groupBy(F.coalesce(reason, F.lit("unknown")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(correct, F.lit(False))).alias("ok"), F.sum(F.coalesce(rounds, F.lit(0))).alias("rounds")
    )
    made = per.agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.sum("rounds").alias("rounds"), F.array_sort(F.collect_list(F.struct("reason", "n"))).alias("reasons"))
    return made.where("n > 0").select(
        F.col("n").alias("total_questions"), F.col("ok").alias("judge_correct"), (F.col("ok") / F.col("n")).alias("judge_accuracy"),
        (F.col("rounds") / F.col("n")).alias("average_rounds"), F.col("reasons").alias("termination_distribution"),
    )


def report(results: DataFrame, by: list[str], correct: str, exact: str, f1: str, seconds: str, error: str) -> DataFrame:
    """Per group: total_samples, correct_samples, accuracy, exact_match_rate, average_f1_score, average_execution_time,
    error_count (rows with a message that isn't empty)."""
    n = F.count(F.lit(1))
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return results.groupBy(*by).agg(
        n.alias("total_samples"), yes(correct).alias("correct_samples"), (yes(correct) / n).alias("accuracy"), (yes(exact) / n).alias("exact_match_rate"),
        F.avg(f1).alias("average_f1_score"), F.avg(seconds).alias("average_execution_time"), F.count_if(F.coalesce(F.col(error) != "", F.lit(False))).alias("error_count"),
    )


def tool_usage(actions: DataFrame, by: list[str], kind: str, calls: str, single: str) -> DataFrame:
    """(by, tool, n): how often each tool was called, by actions of the kind tool_calls (an array of names) or tool_call (one)."""
    names = F.when(F.col(kind) == "tool_calls", F.col(calls)).when(F.col(kind) == "tool_call", F.array(single))
    rows = actions.select(*by, F.explode(names).alias("tool")).where("tool <> ''")
    return rows.groupBy(*by, "tool").agg(F.count(F.lit(1)).alias("n"))


def contest_of(problem: Column) -> Column:
    """The number in front of a problem's name; a name without one or without a capital letter behind it is an error."""
    number = F.regexp_extract(problem, r"^(\d+)[A-Z]", 1)
    wrong = F.raise_error(F.concat(F.lit("not a problem's name: "), F.coalesce(problem, F.lit("null")))).cast("int")
    return F.when(F.coalesce(number, F.lit("")) != "", number.try_cast("int")).otherwise(wrong)


def expanded(histogram: DataFrame, value: str, count: str) -> DataFrame:
    """A row for each of a histogram's counts, as numbers; counts of zero or less give none."""
    n = F.greatest(F.col(count).cast("int"), F.lit(0))
    return histogram.select(F.explode(F.array_repeat(F.col(value).cast("double"), n)).alias(value))


def strict_zip(left: Column, right: Column) -> Column:
    """Pairs (l, r) of two arrays; arrays of different lengths are an error, null arrays are empty."""
    same = F.coalesce(F.size(left) == F.size(right), left.isNull() & right.isNull())
    pairs = F.zip_with(left, right, lambda a, b: F.struct(a.alias("l"), b.alias("r")))
    return F.when(left.isNull() & right.isNull(), F.slice(pairs, 1, 0)).when(same, pairs).otherwise(F.raise_error(F.lit("arrays of different lengths")).cast("void"))


def tail_recall(targets: DataFrame, docs: DataFrame, target: str, doc: str, vec: str, k: int) -> DataFrame:
    """(q, c, score, rank): the k docs nearest to each target by cosine, where a target that is longer than the docs' vectors
    counts by its last entries. Searched through an inverted file until it is exact; vectors without a direction and shorter
    targets are left out, and a doc of the target's own identifier."""
    index = VectorIndex(docs, doc, vec)
    n = F.size(vec)
    cut = F.when(n > index.dim, F.slice(vec, n - index.dim + 1, F.lit(index.dim))).otherwise(F.col(vec))
    return index.search(targets.select(F.col(target), cut.alias(vec)), target, vec, k, exact=True)


def asset_text(ip: Column, source: Column, risk: Column, tags: Column, service: Column, names: Column) -> Column:
    """An asset record as lines for a reader: the record with its first five tags, the service on the port that was asked for
    (struct port, proto, service, server, tls, cert_cn, self_signed, alpn, tags; may be null) and the first three names."""
    listed = lambda a, n: F.concat(F.lit("["), F.array_join(F.transform(F.slice(a, 1, n), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    said = lambda b: F.when(b, "True").otherwise("False")
    s = service
    line = F.concat(
        F.lit("  port "), s["port"].cast("string"), F.lit("/"), s["proto"], F.lit(": service="), s["service"],
        F.when(F.coalesce(s["server"], F.lit("")) != "", F.concat(F.lit(", Server="), s["server"])).otherwise(""),
        F.when(s["tls"], F.concat(F.lit(", TLS=true (cert_cn='"), F.coalesce(s["cert_cn"], F.lit("")), F.lit("', self_signed="), said(s["self_signed"]), F.lit(")"))).otherwise(""),
        F.when(F.size(s["alpn"]) > 0, F.concat(F.lit(", ALPN="), listed(s["alpn"], 1 << 20))).otherwise(""), F.lit(", tags="), listed(F.coalesce(s["tags"], F.array().cast("array<string>")), 1 << 20),
    )
    head = F.concat(F.lit("- asset ("), ip, F.lit(", source="), F.coalesce(source, F.lit("?")), F.lit("): risk_score="), F.coalesce(risk.cast("string"), F.lit("None")), F.lit(", tags="), listed(tags, 5))
    more = F.when(F.size(names) > 0, F.concat(F.lit("  names: "), listed(names, 3)))
    known = F.array_join(F.array_compact(F.array(head, F.when(s.isNotNull(), line), more)), "\n")
    return F.when(source.isNull() & tags.isNull(), F.concat(F.lit("- asset: nothing known of "), ip)).otherwise(known)


def evidence_text(evidence: DataFrame, case: str, order: str, skill: str, step: str, judgment: str) -> DataFrame:
    """(case, text): each case's evidence as a line, in order."""
    q = lambda c: F.coalesce(c, F.lit("?"))
    line = F.concat(F.lit("  - ["), q(skill), F.lit("] "), q(step), F.lit(": "), q(judgment))
    rows = evidence.groupBy(case).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("x"))
    return rows.select(case, F.array_join(F.transform("x", lambda e: e["l"]), "\n").alias("text"))
