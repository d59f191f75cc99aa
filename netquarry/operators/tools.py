"""Packet tools by name, so that rule steps in a table can ask for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions import text, tls
from netquarry.operators import handshakes, packets

Tool = Callable[[DataFrame, dict], DataFrame]
TOOLS: dict[str, Tool] = {}


def tool(f: Tool) -> Tool:
    TOOLS[f.__name__] = f
    return f


def run(name: str, rows: DataFrame, params: dict | None = None, context: dict | None = None) -> DataFrame:
    """The named tool over packet rows; a parameter $key is looked up in the context, '' if it isn't there."""
    if name not in TOOLS:
        raise ValueError(f"no tool {name}")
    known = {k: (context or {}).get(v[1:], "") if isinstance(v, str) and v.startswith("$") else v for k, v in (params or {}).items()}
    return TOOLS[name](rows, known)


def _filtered(rows: DataFrame, params: dict) -> DataFrame:
    """Rows whose columns equal the parameters that name columns."""
    for k, v in params.items():
        if k in rows.columns:
            rows = rows.where(F.col(k) == v)
    return rows


@tool
def list_packets(rows: DataFrame, params: dict) -> DataFrame:
    return _filtered(rows, params).orderBy("t", "frame").limit(int(params.get("n", 50)))


@tool
def conversations(rows: DataFrame, params: dict) -> DataFrame:
    return packets.conversations(_filtered(rows, params), "src", "dst", F.col("len"), F.col("t"))


@tool
def endpoints(rows: DataFrame, params: dict) -> DataFrame:
    return packets.endpoints(_filtered(rows, params), "src", "dst", "len")


@tool
def heartbeat(rows: DataFrame, params: dict) -> DataFrame:
    """The period of small packets, of each capture where rows name theirs (`file`), else of all."""
    small = _filtered(rows, params).where(F.col("len") <= int(params.get("most_bytes", 200)))
    if "file" in rows.columns:
        return packets.heartbeat(small, "file", F.floor("t"), int(params.get("most", 10)))
    return packets.heartbeat(small.withColumn("all", F.lit(1)), "all", F.floor("t"), int(params.get("most", 10))).drop("all")


def _by(rows: DataFrame) -> list[str]:
    return ["file"] if "file" in rows.columns else []


@tool
def session_span(rows: DataFrame, params: dict) -> DataFrame:
    return packets.session_span(_filtered(rows, params), _by(rows), F.col("t"), float(params.get("long", 60)))


@tool
def direction_ratio(rows: DataFrame, params: dict) -> DataFrame:
    """Bytes between the hosts `a` and `b` each way; other packets don't count."""
    a, b = params["a"], params["b"]
    between = rows.where(((F.col("src") == a) & (F.col("dst") == b)) | ((F.col("src") == b) & (F.col("dst") == a)))
    return packets.direction_ratio(between, _by(rows), F.col("len"), F.col("src") == a, float(params.get("suspect", 1.1)))


@tool
def protocol_hierarchy(rows: DataFrame, params: dict) -> DataFrame:
    return packets.protocol_hierarchy(_filtered(rows, params), F.col("protocols"), F.col("len"))


@tool
def client_hellos(rows: DataFrame, params: dict) -> DataFrame:
    """Packets whose payload begins or holds a client hello, with what it says."""
    found = _filtered(rows, params).withColumn("hello", tls.first_client_hello("payload_hex"))
    return found.where("hello.ja3 is not null").select(*rows.columns, "hello.*")


@tool
def quic(rows: DataFrame, params: dict) -> DataFrame:
    return handshakes.quic_headers(_filtered(rows, params), "payload_hex")


@tool
def size_buckets(rows: DataFrame, params: dict) -> DataFrame:
    return packets.size_buckets(_filtered(rows, params), F.col("len"))


@tool
def byte_pattern(rows: DataFrame, params: dict) -> DataFrame:
    """Rows whose payload holds a hex pattern on a byte border, and the byte where it begins, from 1."""
    at = text.byte_position(F.try_to_binary("payload_hex", F.lit("hex")), bytes.fromhex(params["pattern"]))
    return _filtered(rows, {k: v for k, v in params.items() if k != "pattern"}).withColumn("at", at).where("at > 0")


@tool
def capture_info(rows: DataFrame, params: dict) -> DataFrame:
    span = F.max("t") - F.min("t")
    return _filtered(rows, params).agg(F.count(F.lit(1)).alias("n"), span.alias("duration"), F.try_divide(F.count(F.lit(1)), span).alias("rate"), F.avg("len").alias("mean_len"))
