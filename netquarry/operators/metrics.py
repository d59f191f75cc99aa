"""Classification, success-at-k and reward metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1 (0 where undefined)."""
    n = lambda c: F.count_if(c)
    counts = df.select(truth.alias("t"), predicted.alias("p")).agg(
        n(F.col("t") & F.col("p")).alias("tp"), n(~F.col("t") & F.col("p")).alias("fp"),
        n(F.col("t") & ~F.col("p")).alias("fn"), n(~F.col("t") & ~F.col("p")).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts.withColumn("accuracy", _ratio(tp + tn, tp + fp + fn + tn))
    out = out.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
    return out.withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, f1 and support of every class that is true or predicted somewhere."""
    both = F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    right = (F.col(truth) == F.col(predicted)).cast("int")
    rows = df.select(both.alias("x"), right.alias("ok")).select("x.c", "x.t", "x.p", "ok")
    sums = rows.groupBy(F.col("c").alias("class")).agg(
        F.sum("t").alias("support"), F.sum("p").alias("n_predicted"), F.sum(F.col("t") * F.col("ok")).alias("n_right")
    )
    out = sums.withColumn("precision", _ratio(F.col("n_right"), F.col("n_predicted")))
    out = out.withColumn("recall", _ratio(F.col("n_right"), F.col("support")))
    return out.withColumn("f1", _ratio(2 * F.col("n_right"), F.col("support") + F.col("n_predicted")))


def pass_at_k(attempts: DataFrame, problem: str, order: list[str], ok: Column) -> DataFrame:
    """Per k: attempts and share right among the k-th ones (pass@1 of round k), and the share of all problems that have a
    right one among their first k, or all they have."""
    rows = attempts.withColumn("k", F.row_number().over(Window.partitionBy(problem).orderBy(*order))).withColumn("_ok", ok.cast("int"))
    rounds = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("_ok").alias("pass_1"))
    firsts = rows.groupBy(problem).agg(F.coalesce(F.min(F.when(F.col("_ok") == 1, F.col("k"))), F.lit(0)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("_new"))
    # One row for each number of attempts that any problem has.
    both = rounds.join(firsts, "k", "full")
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    solved = F.sum(F.when(F.col("k") > 0, F.coalesce("_new", F.lit(0))).otherwise(0)).over(upto)
    every = F.sum(F.coalesce("_new", F.lit(0))).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return both.withColumn("pass_k", solved / every).where("n is not null").select("k", "n", "pass_1", "pass_k")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _discounted(rewards: pd.Series, gamma: pd.Series) -> pd.Series:
    def one(values, g):
        out, total = [0.0] * len(values), 0.0
        for i in range(len(values) - 1, -1, -1):
            out[i] = total = float(values[i]) + g * total
        return out

    return pd.Series([one(v, g) for v, g in zip(rewards, gamma, strict=True)])


def discounted_return(steps: DataFrame, trajectory: str, order: str, reward: str, gamma: float) -> DataFrame:
    """(trajectory, order, ret): discounted sum of the rewards from each step on, folded from a trajectory's last step, so
    that it holds for trajectories of any length."""
    runs = steps.groupBy(trajectory).agg(F.array_sort(F.collect_list(F.struct(order, F.coalesce(reward, F.lit(0.0)).cast("double").alias("r")))).alias("s"))
    made = runs.withColumn("g", _discounted(F.col("s.r"), F.lit(gamma)))
    return made.select(trajectory, F.explode(F.arrays_zip(F.col(f"s.{order}").alias(order), F.col("g").alias("ret"))).alias("x")).select(trajectory, f"x.{order}", "x.ret")


def group_advantage(df: DataFrame, group: str, reward: str) -> DataFrame:
    """(reward - group mean) / population deviation; a single member keeps its reward, a constant group isn't scaled."""
    w = Window.partitionBy(group)
    mean, std, n = F.avg(reward).over(w), F.stddev_pop(reward).over(w), F.count(F.lit(1)).over(w)
    centred = F.col(reward) - mean
    return df.withColumn("advantage", F.when(n == 1, F.col(reward)).when(std <= 1e-8, centred).otherwise(centred / std))


def varied_groups(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Rows of groups whose rewards differ; if there are none, those of the first group."""
    stats = df.groupBy(group).agg(F.min(reward).alias("_lo"), F.max(reward).alias("_hi"))
    all_ = stats.groupBy().agg(F.max((F.col("_hi") > F.col("_lo")).cast("int")).alias("_some"), F.min(group).alias("_first")).withColumn("_one", F.lit(1))
    judged = stats.withColumn("_one", F.lit(1)).join(F.broadcast(all_), "_one")  # a single row
    keep = judged.where(F.when(F.col("_some") == 1, F.col("_hi") > F.col("_lo")).otherwise(F.col(group) == F.col("_first")))
    return df.join(keep.select(group), group, "left_semi")


def contest_ratings(tries: DataFrame, standings: DataFrame, most_tries: int) -> DataFrame:
    """Per contest: score, penalty, rank, rating, percentile.

    `tries` (contest, problem, points, nth from 0, right): a problem counts by its first right attempt of the first
    `most_tries`, at 50 less for each before it, or where it has no points at 1 and a penalty of 10 for each. `standings`
    (contest, r, points, late): those who aren't beaten by score, then penalty, are ahead. The rating is the largest whole
    number whose expected place isn't better than the rank, found by halving over a histogram of ratings (as many rows as
    there are ratings, not people). Percentile: share of all ratings below."""
    first = F.min(F.when(F.col("right") & (F.col("nth") < most_tries), F.col("nth")))
    solved = tries.groupBy("contest", "problem", "points").agg(first.alias("i"))
    bare = F.col("points").isNull()
    gain = F.when(F.col("i").isNull(), 0).when(bare, 1).otherwise(F.greatest(F.lit(0), F.col("points") - 50 * F.col("i")))
    lost = F.when(bare & F.col("i").isNotNull(), 10 * F.col("i")).otherwise(0)
    scores = solved.groupBy("contest").agg(F.sum(gain).cast("long").alias("score"), F.sum(lost).cast("long").alias("penalty"))
    hist = standings.groupBy("contest", "r").agg(F.count(F.lit(1)).alias("n"))
    people = standings.groupBy("contest", "points", "late").agg(F.count(F.lit(1)).alias("n")).join(scores, "contest")
    behind = (F.col("points") < F.col("score")) | ((F.col("points") == F.col("score")) & (F.col("late") > F.col("penalty")))
    ranks = people.groupBy("contest", "score", "penalty").agg(F.sum(F.when(behind, 0).otherwise(F.col("n"))).alias("rank"))
    ratings = hist.groupBy("contest").agg(F.collect_list(F.struct("r", "n")).alias("hist"), F.max("r").alias("most"))

    def halved(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2)
        place = F.aggregate("hist", F.lit(1.0), lambda x, h: x + h["n"] / (1 + F.pow(F.lit(10.0), (mid - h["r"]) / 400)))
        low = place >= F.col("rank")
        go = at["hi"] - at["lo"] > 1
        return F.struct(F.when(go & low, mid).otherwise(at["lo"]).alias("lo"), F.when(go & ~low, mid).otherwise(at["hi"]).alias("hi"))

    ends = F.struct(F.lit(0).cast("long").alias("lo"), (F.col("most") + 100).cast("long").alias("hi"))
    found = ranks.join(ratings, "contest").withColumn("rating", F.aggregate(F.sequence(F.lit(1), F.lit(40)), ends, halved)["lo"])
    found = found.select("contest", "score", "penalty", "rank", "rating")
    # Both sides in one order, as many rows as ratings and contests: no pairs of them.
    both = hist.groupBy("r").agg(F.sum("n").alias("n")).unionByName(found.withColumn("r", F.col("rating")).withColumn("n", F.lit(0)), allowMissingColumns=True)
    below = F.coalesce(F.sum("n").over(Window.orderBy("r").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.round(below / F.sum("n").over(Window.partitionBy()) * 100, 1)
    return both.withColumn("percentile", share).where("rating is not null").select(*found.columns, "percentile")
