"""Packets of a flow put together in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flow_payload(packets: DataFrame, key: str, order: list[str], text: Column, limit: int) -> DataFrame:
    """Per flow: all packets counted, and their texts joined in order until `limit` characters were there before.

    The text is cut to the limit and marked if it is longer."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = packets.withColumn("_text", text)
    rows = rows.withColumn("_before", F.coalesce(F.sum(F.length("_text")).over(before), F.lit(0)))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    kept = F.when(F.col("_before") < limit, F.struct("_nth", "_text"))
    got = rows.groupBy(key).agg(F.count(F.lit(1)).alias("packets"), F.array_sort(F.collect_list(kept)).alias("_parts"))
    joined = F.array_join(F.transform("_parts", lambda p: p["_text"]), "")
    cut = F.when(F.length(joined) > limit, F.concat(F.substring(joined, 1, limit), F.lit("...[TRUNCATED]"))).otherwise(joined)
    return got.select(key, "packets", cut.alias("payload"))


def directions(packets: DataFrame, key: str, order: list[str], text: str, forward: Column) -> DataFrame:
    """The streams of both directions of each flow, each in order."""
    part = F.struct(*order, F.col(text).alias("_text"))
    stream = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda p: p["_text"]), "")
    return packets.groupBy(key).agg(stream(F.when(forward, part)).alias("out"), stream(F.when(~forward, part)).alias("back"))


def summary(flows: DataFrame, key: str, text: str, head: int = 256, limit: int = 1500, between: str = "\n---\n") -> DataFrame:
    """(key, summary): the distinct beginnings of a key's payloads, in order, joined and cut at `limit` characters.

    Only as many beginnings as can show are gathered: each has a character at least and a separator, so a key with very many
    payloads still is a small row, and each task keeps that many before the shuffle. Blank payloads don't count; a key
    without any has an empty summary."""
    most = limit // (1 + len(between)) + 1
    begin = F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), 1, head)
    distinct = flows.select(F.col(key), begin.alias("_head")).distinct()
    w = Window.partitionBy(key).orderBy((F.col("_head") == "").cast("int"), "_head")
    few = distinct.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    heads = F.array_sort(F.collect_list(F.when(F.col("_head") != "", F.col("_head"))))
    return few.groupBy(key).agg(F.substring(F.array_join(heads, between), 1, limit).alias("summary"))


def conversation(head: dict[str, Column], packets: Column) -> Column:
    """A flow as text for a reader: a header of `head` (uid, proto, service, src, sport, dst, dport) and each of `packets`
    (ts, nth, forward, length, decoded, hex) in order, the beginning of its hex where it has no text."""
    ends = [F.concat_ws(":", head[a], head[p].cast("string")) for a, p in (("src", "sport"), ("dst", "dport"))]
    header = F.concat(
        F.lit("Session UID: "), head["uid"].cast("string"), F.lit("\nProtocol: "), head["proto"], F.lit(" | Service: "),
        F.coalesce(head["service"], F.lit("none")), F.lit("\n"), ends[0], F.lit("  -->  "), ends[1], F.lit("\n" + "=" * 50),
    )

    def line(p: Column) -> Column:
        sender = F.when(p["forward"], F.concat(head["src"], F.lit(" --> ("))).otherwise(F.concat(head["dst"], F.lit(" <-- (")))
        shown = F.coalesce(F.nullif(p["decoded"], F.lit("")), F.concat(F.lit("[HEX ONLY]: "), F.substring(p["hex"], 1, 50), F.lit("...")))
        at = F.concat(F.lit("\n["), F.date_format(p["ts"], "HH:mm:ss.SSS"), F.lit("] "))
        return F.concat(at, sender, p["length"].cast("string"), F.lit(" bytes):\n"), shown, F.lit("\n" + "-" * 20))

    return F.array_join(F.concat(F.array(header), F.transform(F.array_sort(packets), line)), "\n")
