"""Flow identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ipv4_hex(ip: Column) -> Column:
    """Eight hex digits of a dotted IPv4 address."""
    return F.array_join(F.transform(F.split(ip, r"\."), lambda p: F.lpad(F.hex(p.cast("long")), 2, "0")), "")


def community_id(src: Column, dst: Column, sport: Column, dport: Column, proto: Column, seed: int = 0) -> Column:
    """Community ID version 1 of an IPv4 flow: base64 of the SHA-1 of seed, ordered endpoints, protocol and ports."""
    a, b = ipv4_hex(src), ipv4_hex(dst)
    swap = (a > b) | ((a == b) & (sport > dport))
    port = lambda p: F.lpad(F.hex(p.cast("long")), 4, "0")
    first, second = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    p1, p2 = port(F.when(swap, dport).otherwise(sport)), port(F.when(swap, sport).otherwise(dport))
    data = F.concat(F.lit(f"{seed:04X}"), first, second, F.lpad(F.hex(proto.cast("long")), 2, "0"), F.lit("00"), p1, p2)
    return F.concat(F.lit("1:"), F.base64(F.unhex(F.sha1(F.unhex(data)))))


def flow_uid(*parts: Column) -> Column:
    """'C' and 12 hex digits of the MD5 of the flow's key."""
    return F.concat(F.lit("C"), F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 12))
