"""Packets from capture files (libpcap format), read as a table: a large file is many tasks' work.

A capture has no marks between its records, so a place inside it can't be told to be a record's begin. One task for each
file walks the record heads once and writes down every `SPLIT` bytes where a record begins and its number; this index is
small and settled. Then the stretches are dealt to tasks by their bytes, some `SPLIT` each, and read and parsed one by one.

Files are opened through pyarrow's file systems (local, HDFS, S3, ...). A file that isn't a capture is an error; a record
that is cut off at the end of a file ends it. Both byte orders, micro- and nanoseconds are read. Packets without an IP head
have null addresses.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from netquarry.durable import settle, stored
from netquarry.functions.text import printable

SPLIT = 32 << 20
CHUNK = 1 << 20
#: The first four bytes of a capture as they stand there -> (byte order, fractions of a second).
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
_INDEX = "path string, start long, stop long, first long, magic binary, link int"
PACKETS = (
    "file string, frame long, ts double, src string, src_port int, dst string, dst_port int, proto string, length int, captured int, "
    "seq long, flags int, payload binary, data binary"
)
#: IP protocol numbers by name.
_NAMES = {1: "icmp", 6: "tcp", 17: "udp", 58: "icmpv6"}


def _opened(path: str):
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inside)


def _index(path: str, split: int) -> Iterator[tuple]:
    """(path, start, stop, number of the first record, magic, link type) of stretches of whole records."""
    with _opened(path) as f:
        head = f.read(24)
        if len(head) < 24 or head[:4] not in MAGIC:
            raise ValueError(f"not a capture: {path}")
        order, _ = MAGIC[head[:4]]
        link, size = struct.unpack(order + "I", head[20:24])[0], f.size()
        unpack = struct.Struct(order + "I").unpack_from
        at, begin, first, number, base, held = 24, 24, 1, 0, 0, b""
        while at + 16 <= size:
            if at + 16 > base + len(held) or at < base:
                base, held = at, f.read_at(CHUNK, at)
            after = at + 16 + unpack(held, at - base + 8)[0]
            if after > size:
                break
            at, number = after, number + 1
            if at - begin >= split:
                yield path, begin, at, first, head[:4], link
                begin, first = at, number + 1
        if at > begin:
            yield path, begin, at, first, head[:4], link


def _address(raw: bytes) -> str:
    return "%d.%d.%d.%d" % tuple(raw) if len(raw) == 4 else str(ipaddress.ip_address(raw))


def parsed(data: bytes, link: int) -> tuple:
    """(src, src_port, dst, dst_port, proto, seq, flags, payload) of a packet; nulls for what it doesn't have."""
    nothing = (None, None, None, None, None, None, None, b"")
    if link == 1:
        kind, at = data[12:14], 14
        while kind in (b"\x81\x00", b"\x88\xa8"):
            kind, at = data[at + 2 : at + 4], at + 4
        if kind not in (b"\x08\x00", b"\x86\xdd"):
            return nothing
    else:
        at = {0: 4, 113: 16}.get(link, 0)
    ip = data[at:]
    version = ip[0] >> 4 if ip else 0
    if version == 4 and len(ip) >= 20:
        head, end, number = 4 * (ip[0] & 15), int.from_bytes(ip[2:4], "big"), ip[9]
        src, dst, first = ip[12:16], ip[16:20], int.from_bytes(ip[6:8], "big") & 0x1FFF == 0
    elif version == 6 and len(ip) >= 40:
        head, end, number, src, dst, first = 40, 40 + int.from_bytes(ip[4:6], "big"), ip[6], ip[8:24], ip[24:40], True
    else:
        return nothing
    body = ip[head : end or len(ip)]
    src, dst, name = _address(src), _address(dst), _NAMES.get(number, str(number))
    if not first or number not in (6, 17) or len(body) < (20 if number == 6 else 8):
        return src, None, dst, None, name, None, None, body
    sport, dport = struct.unpack(">HH", body[:4])
    if number == 17:
        return src, sport, dst, dport, name, None, None, body[8:]
    return src, sport, dst, dport, name, int.from_bytes(body[4:8], "big"), body[13], body[4 * (body[12] >> 4) :]


def _packets(path: str, start: int, stop: int, first: int, magic: bytes, link: int) -> Iterator[tuple]:
    order, parts = MAGIC[magic]
    head = struct.Struct(order + "IIII").unpack_from
    name = path.rsplit("/", 1)[-1]
    with _opened(path) as f:
        data, at, number = f.read_at(stop - start, start), 0, first
        while at < len(data):
            seconds, fraction, captured, length = head(data, at)
            whole = data[at + 16 : at + 16 + captured]
            src, sport, dst, dport, proto, seq, flags, payload = parsed(whole, link)
            yield name, number, seconds + fraction / parts, src, sport, dst, dport, proto, length, captured, seq, flags, payload, whole
            at, number = at + 16 + captured, number + 1


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def write_subset(packets: DataFrame, folder: str, file: Column) -> int:
    """Writes packets of `read_captures`, as they were captured, to captures named by `file`; returns how many."""
    micros = F.round(F.col("ts") * 1_000_000).cast("long")
    nth = F.struct(F.col("file").alias("f"), "frame")
    whole = packets.select(file.alias("file"), nth.alias("nth"), (micros / 1_000_000).cast("long").alias("seconds"), (micros % 1_000_000).alias("micros"), F.hex("data").alias("frame"))
    whole = settle(whole)
    write_captures(whole, folder)
    return whole.count()


def read_captures(spark: SparkSession, folder: str, pattern: str = "*.pcap", split: int = SPLIT) -> DataFrame:
    """(file, frame, ts, src, src_port, dst, dst_port, proto, length, captured, seq, flags, payload, data (whole)) of all captures."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path")
    index_type = to_arrow_schema(spark.createDataFrame([], _INDEX).schema)
    packet_type = to_arrow_schema(spark.createDataFrame([], PACKETS).schema)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from _batches(_index(path, split), index_type)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _batches(_packets(**row), packet_type)

    some = spark.sparkContext.defaultParallelism
    stretches = settle(files.coalesce(4 * some).mapInArrow(index, _INDEX))
    n, size = stretches.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    tasks = max(1, min(n, max(2 * some, -(-size // SPLIT))))  # else their few bytes are one task
    return stretches.repartition(tasks, "path", "start").mapInArrow(read, PACKETS)


def listed(packets: DataFrame, where: Column | None = None, n: int = 20) -> DataFrame:
    """The first n packets of each file that meet a condition, with the time since the file's first packet."""
    first = packets.groupBy("file").agg(F.min_by("ts", "frame").alias("_t0"))
    rows = packets.where(where) if where is not None else packets
    w = Window.partitionBy("file").orderBy("frame")
    few = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return few.join(first, "file").withColumn("time_relative", F.col("ts") - F.col("_t0")).drop("_t0", "_n")


def capture_flows(packets: DataFrame, max_chars: int = 1024, most: int = 5) -> DataFrame:
    """Conversations of each file: uid, ts (since the file's first packet), both ends (the first packet's sender is the
    originator), duration, packets and bytes each way, state, history, and the printable text of the originator's first
    `most` packets with a payload. Packets are read and written once, as three ways lead from them."""
    ends = [F.struct(F.col(a).alias("h"), F.col(f"{a}_port").alias("p")) for a in ("src", "dst")]
    packets = stored(packets.select("file", "frame", "ts", "src", "src_port", "dst", "dst_port", "proto", "length", "payload"))
    rows = packets.where(F.col("proto").isin("tcp", "udp") & F.col("src_port").isNotNull())
    rows = rows.withColumns({"_lo": F.least(*ends), "_hi": F.greatest(*ends)}).withColumn("_up", ends[0] == F.col("_lo"))
    key = ["file", "proto", "_lo", "_hi"]
    start = packets.groupBy("file").agg(F.min_by("ts", "frame").alias("_t0"))
    sums = rows.groupBy(*key).agg(
        F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.min_by("_up", "frame").alias("_up"),
        *[F.count_if(F.col("_up") == up).alias(f"_n{k}") for k, up in enumerate((True, False))],
        *[F.coalesce(F.sum(F.when(F.col("_up") == up, F.col("length"))), F.lit(0)).alias(f"_b{k}") for k, up in enumerate((True, False))],
    )
    w = Window.partitionBy(*key, "_up").orderBy("frame")
    data = rows.where(F.octet_length("payload") > 0).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.hex("payload").alias("x")))), lambda r: r["x"]), "")
    shown = data.groupBy(*key, "_up").agg(F.substring(printable(F.substring(text, 1, 2 * max_chars)), 1, max_chars).alias("stream_payload_decoded"))
    # Of packed packets Spark takes a small part of their size for all of it, and would send payloads to the driver.
    out = sums.join(shown.hint("merge"), [*key, "_up"], "left").join(start, "file")
    pick = lambda a, b: F.when(F.col("_up"), a).otherwise(b)
    orig, resp = pick(F.col("_lo"), F.col("_hi")), pick(F.col("_hi"), F.col("_lo"))
    names = F.concat_ws("-", orig["h"], orig["p"].cast("string"), resp["h"], resp["p"].cast("string"), "proto")
    count = lambda x, k: pick(F.col(f"_{x}{k}"), F.col(f"_{x}{1 - k}"))
    made = out.select(
        "file", F.concat(F.lit("C"), F.substring(F.md5(names), 1, 12)).alias("uid"), (F.col("_first") - F.col("_t0")).alias("ts"), orig["h"].alias("id_orig_h"), orig["p"].alias("id_orig_p"),
        resp["h"].alias("id_resp_h"), resp["p"].alias("id_resp_p"), "proto", (F.col("_last") - F.col("_first")).alias("duration"), count("b", 0).alias("orig_bytes"), count("b", 1).alias("resp_bytes"),
        count("n", 0).alias("orig_pkts"), count("n", 1).alias("resp_pkts"), F.lit("SF").alias("conn_state"), F.when(F.col("proto") == "tcp", "ShADdaFf").otherwise("Dd").alias("history"),
        F.coalesce("stream_payload_decoded", F.lit("")).alias("stream_payload_decoded"),
    )
    return made.withColumn("batch_index", F.row_number().over(Window.partitionBy("file").orderBy("ts", "proto", "uid")) - 1)


def ipv4_number(address: Column) -> Column:
    """An IPv4 address as a number, null for anything else."""
    parts = F.split(address, r"\.")
    number = F.lit(0).cast("long")
    for k in range(4):
        number = number * 256 + F.get(parts, F.lit(k)).try_cast("long")
    return F.when(F.size(parts) == 4, number)


def frame_hex(src: Column, src_port: Column, dst: Column, dst_port: Column, udp: Column, seq: Column, payload: Column) -> Column:
    """An Ethernet frame with IPv4 and TCP or UDP as hex; addresses are numbers, payload is hex. Checksums are zero. Of a number
    that is too large for its field (a port of 16 bits) the low bytes are written."""
    number = lambda n, size: F.right(F.concat(F.lit("0" * 2 * size), F.hex(n)), F.lit(2 * size))
    size = (F.char_length(payload) / 2).cast("int")
    ports = F.concat(number(src_port, 2), number(dst_port, 2))
    tcp = F.concat(ports, number(seq, 4), F.lit("00000000501820000000" + "0000"), payload)
    body = F.when(udp, F.concat(ports, number(size + 8, 2), F.lit("0000"), payload)).otherwise(tcp)
    total = size + F.when(udp, 28).otherwise(40)
    head = F.concat(F.lit("4500"), number(total, 2), F.lit("0000400040"), F.when(udp, "11").otherwise("06"), F.lit("0000"), number(src, 4), number(dst, 4))
    return F.concat(F.lit("02" * 6 + "04" * 6 + "0800"), head, body)


def write_captures(rows: DataFrame, folder: str, file: str = "file", order: str = "nth") -> None:
    """Captures from (file, nth, seconds, micros, frame as hex): a file for each name, written by one task as a capture is one
    stream of bytes. A task that runs again writes the same file again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
        system, inside = fs.FileSystem.from_uri(uri)
        system.create_dir(inside, recursive=True)
        name, out, n = None, None, 0
        for batch in batches:
            for k, _, seconds, micros, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != name:
                    if out:
                        out.close()
                    name, n = k, n + 1
                    out = system.open_output_stream(f"{inside}/{k}")
                    out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, 1))
                data = bytes.fromhex(frame)
                out.write(struct.pack("<IIII", seconds, micros, len(data), len(data)) + data)
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["files"])

    dealt = rows.select(file, order, "seconds", "micros", "frame").repartition(file).sortWithinPartitions(file, order)
    dealt.mapInArrow(write, "files long").agg(F.sum("files")).collect()
