"""Statistics of packets: conversations, profiles, heartbeats, sizes, directions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE_EDGES = [0, 20, 40, 80, 160, 320, 640, 1280, 2560]


def conversations(packets: DataFrame, src: str, dst: str, size: Column, time: Column) -> DataFrame:
    """Per endpoint pair: frames and bytes each way (a is the smaller endpoint), start and duration."""
    a, b = F.least(src, dst), F.greatest(src, dst)
    ahead = F.col(src) <= F.col(dst)
    rows = packets.select(a.alias("a"), b.alias("b"), ahead.alias("_ahead"), size.alias("_size"), time.alias("_t"))
    return rows.groupBy("a", "b").agg(
        F.count_if("_ahead").alias("frames_ab"), F.count_if(~F.col("_ahead")).alias("frames_ba"),
        F.sum(F.when(F.col("_ahead"), F.col("_size")).otherwise(0)).alias("bytes_ab"),
        F.sum(F.when(~F.col("_ahead"), F.col("_size")).otherwise(0)).alias("bytes_ba"),
        F.min("_t").alias("start"), (F.max("_t") - F.min("_t")).alias("duration"),
    )


#: Ports of services that are often attacked, and the bounds of the port bins.
RISK_PORTS = [22, 23, 25, 53, 80, 135, 139, 443, 445, 993, 995, 1433, 1521, 3306, 3389, 4444, 5432, 5900, 6379, 8080, 8443, 8888, 9200]
PORT_BINS = [(0, 1023), (1024, 49151), (49152, 1 << 31)]
MEASURES = ["duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts"]


#: Rows that are profiled at a time.
_CHUNK = 1 << 15


def batch_profile(flows: DataFrame, by: str, dealt: bool = False) -> DataFrame:
    """(batch, v): 46 statistics of each batch of flows, at norm 1.

    Of the five measures and of the ports of either side: max, min, median and deviation; of the ports: shares of the
    bins and of risk ports; distinct addresses of either side by flows, share of sent bytes, TCP and UDP; distinct ports
    of either side by flows, share of the commonest one, share of port 53. Nulls count as 0. A batch is a window of some 30
    rows, and a task holds _CHUNK rows and a batch. With `dealt`, each batch's rows are neighbours in one partition already
    (ordering.count_windows), and nothing is shuffled."""
    number = lambda c, kind, none: F.coalesce(F.col(c).try_cast(kind), F.lit(none)).alias(c)
    rows = flows.select(
        F.col(by).alias("_by"), *[number(c, "double", 0.0) for c in MEASURES], *[number(c, "int", 0) for c in ("resp_p", "orig_p")],
        *[number(c, "string", "") for c in ("orig_h", "resp_h")], *[F.coalesce(F.lower("proto") == x, F.lit(False)).alias(x) for x in ("tcp", "udp")],
    )
    if not dealt:
        rows = rows.repartition("_by").sortWithinPartitions("_by")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _CHUNK:
                table = pa.Table.from_batches(held).combine_chunks()
                if last := int(_starts(table.column("_by"))[-1]):  # the last batch may go on
                    yield _profiles(table.slice(0, last))
                held = table.slice(last).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield _profiles(pa.Table.from_batches(held).combine_chunks())

    kind = flows.schema[by].dataType.simpleString()
    return rows.mapInArrow(run, f"_by {kind}, v array<double>").withColumnRenamed("_by", by)


def _starts(keys: pa.ChunkedArray) -> np.ndarray:
    """Where each run of equal keys begins; null equals null."""
    a, b = keys.slice(1), keys.slice(0, len(keys) - 1)
    other = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[0], np.flatnonzero(other.to_numpy()) + 1])


def _profiles(rows: pa.Table) -> pa.RecordBatch:
    """The profile of each run of equal keys."""
    start = _starts(rows.column("_by"))
    n = np.diff(np.append(start, rows.num_rows))
    group = np.repeat(np.arange(len(n)), n)
    columns = {c: rows.column(c).to_numpy() for c in (*MEASURES, "resp_p", "orig_p", "tcp", "udp")}
    columns |= {c: rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("orig_h", "resp_h")}
    share = lambda flags: np.add.reduceat(flags.astype(np.int64), start) / n
    ordered = {c: x[np.lexsort((x, group))] for c, x in columns.items() if c not in ("tcp", "udp")}

    def spread(c: str) -> list[np.ndarray]:
        x, up = columns[c].astype(np.float64), ordered[c].astype(np.float64)
        mean = np.add.reduceat(x, start) / n
        deviation = np.sqrt(np.add.reduceat((x - mean[group]) ** 2, start) / n)
        low, high = up[start + (n - 1) // 2], up[start + n // 2]
        return [np.maximum.reduceat(x, start), np.fmin.reduceat(x, start), low + (high - low) / 2, deviation]

    def runs(c: str) -> tuple[np.ndarray, np.ndarray]:
        """(distinct values, how often the commonest one is there) of each batch."""
        opens = np.append(True, np.diff(ordered[c]) != 0)
        opens[start] = True
        first = np.flatnonzero(opens)
        at = np.searchsorted(first, start)
        return np.diff(np.append(at, len(first))), np.maximum.reduceat(np.diff(np.append(first, len(opens))), at)

    ports = ("resp_p", "orig_p")
    stats = [x for c in (*MEASURES, *ports) for x in spread(c)]
    for p in (columns[c] for c in ports):
        stats += [share((p >= lo) & (p <= hi)) for lo, hi in PORT_BINS] + [share(np.isin(p, RISK_PORTS))]
    stats += [runs(c)[0] / n for c in ("orig_h", "resp_h")]
    sent, got = (np.add.reduceat(columns[c], start) for c in ("orig_bytes", "resp_bytes"))
    stats += [sent / (sent + got + 1), share(columns["tcp"]), share(columns["udp"])]
    stats += [runs(c)[0] / n for c in ports] + [runs(c)[1] / n for c in ports] + [share(columns["resp_p"] == 53)]
    v = np.stack(stats, axis=1)
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    v = np.divide(v, size, out=v.copy(), where=size > 0).ravel()
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) + 1, len(stats)), pa.int32()), pa.array(v, pa.float64()))
    return pa.RecordBatch.from_arrays([rows.column("_by").combine_chunks().take(pa.array(start)), lists], ["_by", "v"])


def heartbeat(packets: DataFrame, by: str, second: Column, most: int = 10) -> DataFrame:
    """Flows with a period: the commonest gap between seconds of 1 to `most` packets, of equal ones the first, if there are
    at least three such seconds and the gap is 5 s or more and seen twice."""
    seconds = packets.groupBy(by, second.alias("s")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
    gaps = seconds.withColumn("gap", F.col("s") - F.lag("s").over(Window.partitionBy(by).orderBy("s")))
    counts = gaps.where("gap is not null").groupBy(by, "gap").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first"))
    best = F.max_by("gap", F.struct("n", -F.col("first")))
    found = counts.groupBy(by).agg(best.alias("period"), F.max("n").alias("times"))
    return found.where("period >= 5 and times >= 2")  # two gaps are three seconds


def size_buckets(packets: DataFrame, size: Column, edges: list[int] = SIZE_EDGES) -> DataFrame:
    """Packets, mean size and percent in each bucket of sizes, with the percent of full packets (mtu_pct, the last closed
    bucket) and of small ones (small_pct, the first four). Sizes below the first edge or null are in a bucket of null."""
    bucket = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:], strict=False):
        bucket = F.when(size.between(lo, hi - 1), f"{lo}-{hi - 1}").otherwise(bucket)
    bucket = F.when(size >= edges[-1], f"{edges[-1]}_and_greater").otherwise(bucket)
    names = [f"{lo}-{hi - 1}" for lo, hi in zip(edges, edges[1:], strict=False)]
    counts = packets.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(size).alias("avg"))
    of = lambda some: F.coalesce(F.sum(F.when(F.col("bucket").isin(some), F.col("n"))), F.lit(0))
    whole = counts.agg(F.sum("n").alias("all"), of(names[-1:]).alias("mtu"), of(names[:4]).alias("small")).withColumn("one", F.lit(1))
    rows = counts.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one")  # a row for each bucket
    percent = lambda c: F.col(c) * 100 / F.col("all")
    return rows.select("bucket", "n", "avg", percent("n").alias("percent"), percent("mtu").alias("mtu_pct"), percent("small").alias("small_pct"))


def endpoints(packets: DataFrame, src: str, dst: str, size: str) -> DataFrame:
    """Frames and bytes of each address, from one scan."""
    rows = packets.select(size, F.explode(F.array(src, dst)).alias("ip"))
    return rows.groupBy("ip").agg(F.count(F.lit(1)).alias("frames"), F.sum(size).alias("bytes"))


def direction_ratio(packets: DataFrame, by: list[str], size: Column, forward: Column, suspect: float = 1.1) -> DataFrame:
    """Bytes each way, backward by forward (0 where nothing went forward), and whether that is over `suspect`."""
    way = lambda c: F.coalesce(F.sum(F.when(c, size)), F.lit(0)).cast("double")
    rows = packets.groupBy(*by).agg(way(forward).alias("ab"), way(~forward).alias("ba"))
    ratio = F.coalesce(F.try_divide("ba", "ab"), F.lit(0.0))
    return rows.withColumn("ratio", ratio).withColumn("suspect", F.col("ratio") > suspect)


def session_span(packets: DataFrame, by: list[str], seconds: Column, long: float) -> DataFrame:
    """Seconds from each session's first to its last packet, and whether they are over `long`."""
    span = F.max(seconds) - F.min(seconds)
    return packets.groupBy(*by).agg(span.alias("span"), (span > long).alias("long"))


def protocol_hierarchy(packets: DataFrame, stack: Column, size: Column) -> DataFrame:
    """Frames and bytes of every prefix of the protocol stacks (`eth:ip:tcp`). Whole stacks are summed up first, so that
    prefixes are made from a few rows and not from every packet."""
    rows = packets.groupBy(F.split(stack, ":").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("q"))
    rows = rows.withColumn("depth", F.explode(F.sequence(F.lit(1).cast("long"), F.size("p").cast("long"))))
    rows = rows.withColumn("path", F.array_join(F.slice("p", F.lit(1), F.col("depth").cast("int")), ":"))
    return rows.groupBy("path", "depth").agg(F.sum("n").alias("frames"), F.sum("q").alias("bytes"))


def neighbours(edges: DataFrame, src: str, dst: str, hosts: list) -> DataFrame:
    """(host, way, other): the distinct ends of edges that begin ('out') or end ('in') at one of `hosts`."""
    out = edges.where(F.col(src).isin(hosts)).select(F.col(src).alias("host"), F.lit("out").alias("way"), F.col(dst).alias("other"))
    back = edges.where(F.col(dst).isin(hosts)).select(F.col(dst).alias("host"), F.lit("in").alias("way"), F.col(src).alias("other"))
    return out.unionByName(back).distinct()


def verdict(evidence: DataFrame, case: str, skill: str, step: str) -> DataFrame:
    """The skill that the evidence of each case speaks for, with a confidence.

    Steps after a hard hit (hard and passed), or after a failed step that aborts, don't count. The skill with most hard
    hits wins, of equal ones the one whose first hard hit comes first; else the one with the highest passes + 3 * specific passes + 0.5 * pass rate, at a confidence of
    0.8 * rate. Of equal skills the one whose evidence comes first wins. Attack above 0.5."""
    before = Window.partitionBy(case, skill).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    stop = F.max(((F.col("hard") & F.col("passed")) | (~F.col("passed") & F.col("aborts"))).cast("int")).over(before)
    rows = evidence.withColumn("_stop", F.coalesce(stop, F.lit(0))).where("_stop = 0")
    per = rows.groupBy(case, skill).agg(
        F.count_if("passed").alias("n_pass"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("hard") & F.col("passed")).alias("n_hard"),
        F.coalesce(F.min(F.when(F.col("hard") & F.col("passed"), F.col(step))), F.min(step)).alias("_first"),
        F.count_if(F.col("passed") & F.col("specific")).alias("n_specific"),
    )
    rate = F.col("n_pass") / F.col("n")
    per = per.withColumn("score", F.when(F.col("n_hard") > 0, 1e9 * F.col("n_hard")).otherwise(F.col("n_pass") + 3 * F.col("n_specific") + 0.5 * rate))
    per = per.withColumn("confidence", F.when(F.col("n_hard") > 0, 1.0).otherwise(0.8 * rate))
    w = Window.partitionBy(case).orderBy(F.desc(F.round("score", 6)), "_first", skill)
    best = per.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return best.select(case, skill, "n_pass", "confidence", (F.col("confidence") > 0.5).alias("attack"))


#: Ports that speak for a skill.
QUIC_PORTS, WEB_PORTS = [443, 7003, 8443, 4433], [80, 8080, 7004]


def skill_order(udp: Column, tcp: Column, ports: Column, tls: Column, skills: list[str]) -> Column:
    """Array of (score, skill), best fit first and `skills` order among equals, from counts of UDP and TCP, the ports met and
    whether there is TLS."""
    met = lambda xs: F.arrays_overlap(ports, F.array(*map(F.lit, xs)))
    has_udp, has_tcp, web, quic = udp > 0, tcp > 0, met(WEB_PORTS), met(QUIC_PORTS)
    std = F.array_contains(ports, 443)
    fit = {
        "quic": F.when(has_udp & quic, 100).when(has_udp, 50).otherwise(5),
        "kcp": F.when(has_udp & ~quic, 90).when(has_udp, 40).otherwise(10),
        "wss": F.when(has_tcp & std & tls, 95).otherwise(25),
        "ws": F.when(has_tcp & web & ~tls, 85).otherwise(20),
        "tcp_tls": F.when(has_tcp & tls & ~std, 75).otherwise(30),
        "tcp": F.when(has_tcp, 60).otherwise(5),
    }
    rated = [F.struct((-fit.get(s, F.lit(1))).alias("less"), F.lit(i).alias("i"), F.lit(s).alias("skill")) for i, s in enumerate(skills)]
    return F.transform(F.array_sort(F.array(*rated)), lambda x: F.struct((-x["less"]).alias("score"), x["skill"].alias("skill")))


def flow_features(flows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(uid, f0 .. f17), log1p of 12 host counts and 6 of the flow.

    Flows, packets and bytes sent and received by the source, then by the destination; the flow's packets, duration and
    bytes, and least, largest and mean packet length of `lengths` (uid, lo, hi, mean), for a flow without packets 0, 0 and
    the mean of its own counts. `flows`: uid, src, dst, orig_pkts, resp_pkts, orig_bytes, resp_bytes, duration."""
    zero = F.lit(0)
    end = lambda host, sent, got: F.struct(
        F.col(host).alias("host"), *[x.alias(n) for n, x in zip(("sf", "sp", "sb"), sent)], *[x.alias(n) for n, x in zip(("rf", "rp", "rb"), got)]
    )
    nothing = [zero.cast("long")] * 3
    counts = lambda side: [F.lit(1).cast("long"), F.col(f"{side}_pkts").cast("long"), F.col(f"{side}_bytes").cast("long")]
    ends = flows.select(F.explode(F.array(end("src", counts("orig"), nothing), end("dst", nothing, counts("resp")))).alias("x")).select("x.*")
    names = ["sf", "sp", "sb", "rf", "rp", "rb"]
    hosts = ends.groupBy("host").agg(*[F.sum(n).alias(n) for n in names])
    rows = flows.join(lengths, "uid", "left")
    for side in ("src", "dst"):
        rows = rows.join(hosts.select(F.col("host").alias(side), *[F.col(n).alias(f"{side}_{n}") for n in names]), side, "left")
    packets, size = F.col("orig_pkts") + F.col("resp_pkts"), F.col("orig_bytes") + F.col("resp_bytes")
    mean = F.coalesce("mean", F.when(packets > 0, size / packets).otherwise(0.0))
    values = [F.coalesce(f"{side}_{n}", zero) for side in ("src", "dst") for n in names]
    values += [packets, F.col("duration"), size, F.coalesce("lo", zero), F.coalesce("hi", zero), mean]
    return rows.select("uid", *[F.log1p(v.cast("double")).alias(f"f{i}") for i, v in enumerate(values)])
