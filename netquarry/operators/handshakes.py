"""HTTP, WebSocket and QUIC records from the streams and datagrams of flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_METHODS = "GET|HEAD|POST|PUT|DELETE|CONNECT|OPTIONS|TRACE|PATCH"
_REQUEST = rf"(?m)(?=^(?:{_METHODS}) \S+ HTTP/1\.[01]\r?$)"
_RESPONSE = r"(?m)(?=^HTTP/1\.[01] \d{3}(?: [^\r\n]*)?\r?$)"


def _heads(stream: Column, start: str, begins: str) -> Column:
    """The heads of a direction's messages: cut at each line that begins one, up to the first blank line."""
    pieces = F.filter(F.split(F.coalesce(stream, F.lit("")), start, -1), lambda p: F.rlike(p, F.lit(begins)))
    return F.transform(pieces, lambda p: F.substring_index(F.substring_index(p, "\r\n\r\n", 1), "\n\n", 1))


def _field(head: Column, name: str) -> Column:
    """A header's value, '' without one."""
    return F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)


def http_records(streams: DataFrame, key: list[str], client: str, server: str) -> DataFrame:
    """One row for each exchange of a flow, in the order of its streams: nth (from 0), method, uri, host, user_agent, upgrade,
    websocket_key of the request and status, phrase, server, content_type, accept_key of the response.

    `client` and `server` are the reassembled texts of both directions (see payload.directions). HTTP/1 answers in order, so
    the nth response belongs to the nth request; one that is missing on either side is null. A body's line that looks like a
    start line begins a message. Flows without a message and null streams give no row."""
    requests = _heads(F.col(client), _REQUEST, rf"^(?:{_METHODS}) \S+ HTTP/1\.[01]\r?(?:\n|$)")
    responses = _heads(F.col(server), _RESPONSE, r"^HTTP/1\.[01] \d{3}")
    pairs = F.arrays_zip(requests.alias("q"), responses.alias("r"))
    rows = streams.select(*key, F.posexplode(pairs).alias("nth", "x")).select(*key, "nth", F.col("x.q").alias("_q"), F.col("x.r").alias("_r"))
    line = lambda head, pattern: F.regexp_extract(head, pattern, 1)
    q, r = F.col("_q"), F.col("_r")
    return rows.select(
        *key, "nth", line(q, r"^(\S+) ").alias("method"), line(q, r"^\S+ (\S+) ").alias("uri"), _field(q, "Host").alias("host"),
        _field(q, "User-Agent").alias("user_agent"), _field(q, "Upgrade").alias("upgrade"), _field(q, "Sec-WebSocket-Key").alias("websocket_key"),
        line(r, r"^\S+ (\d{3})").try_cast("int").alias("status"), line(r, r"^\S+ \d{3} ?([^\r\n]*)").alias("phrase"), _field(r, "Server").alias("server"),
        _field(r, "Content-Type").alias("content_type"), _field(r, "Sec-WebSocket-Accept").alias("accept_key"),
    )


def http_summary(records: DataFrame, by: list[str], path: str) -> DataFrame:
    """Per capture: requests, responses, upgrades that were asked for and granted, distinct addresses and agents in order, and
    whether an address holds `path`. Sets are of distinct values, counted before the shuffle."""
    asked = F.col("method") != ""
    some = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    upgrade = F.coalesce(F.col("upgrade") != "", F.lit(False))
    return records.groupBy(*by).agg(
        F.count_if(asked).alias("requests"), F.count("status").alias("responses"), F.count_if(upgrade).alias("upgrades"), F.count_if(F.col("status") == 101).alias("switched"),
        some("uri").alias("uris"), some("user_agent").alias("agents"), F.coalesce(F.bool_or(F.contains("uri", F.lit(path))), F.lit(False)).alias("has_path"),
    )


#: Fixed value: the version number of QUIC's second version, whose Initial packets have type 1.
_SECOND = 0x6B3343CF


def quic_headers(datagrams: DataFrame, payload: str) -> DataFrame:
    """Datagrams that begin with a QUIC long header, with version, dcid and scid (hex) and whether it is an Initial packet.
    payload is hex. Connection identifiers of over 20 bytes, version 0 (negotiation) and short datagrams aren't headers."""
    h = F.upper(F.col(payload))
    number = lambda at, size: F.conv(F.substr(h, F.lit(at) if isinstance(at, int) else at, F.lit(2 * size)), 16, 10).try_cast("long")
    first, version, dn = number(1, 1), number(3, 4), number(11, 1)
    rows = datagrams.withColumns({"_first": first, "version": version, "_dn": dn})
    sn = number(F.lit(13) + 2 * F.col("_dn"), 1)
    rows = rows.withColumn("_sn", sn).where((F.col("_first") >= 0xC0) & (F.col("version") > 0) & (F.col("_dn") <= 20) & (F.col("_sn") <= 20))
    kind = F.shiftright(F.col("_first").bitwiseAND(F.lit(0x30)), 4)
    rows = rows.where(F.char_length(h) >= 14 + 2 * (F.col("_dn") + F.col("_sn")))
    return rows.withColumns({
        "dcid": F.substr(h, F.lit(13), (2 * F.col("_dn")).cast("int")), "scid": F.substr(h, (15 + 2 * F.col("_dn")).cast("int"), (2 * F.col("_sn")).cast("int")),
        "initial": kind == F.when(F.col("version") == _SECOND, 1).otherwise(0),
    }).drop("_first", "_dn", "_sn")


def quic_summary(headers: DataFrame, by: list[str], alpn: str | None = None, sni: str | None = None, token: str = "frp") -> DataFrame:
    """Per capture: versions met, Initial packets and connections; with decoded columns also the sets of protocols and names and
    whether a protocol is `token`."""
    some = lambda c: F.array_sort(F.collect_set(c))
    more = [some(alpn).alias("alpn"), F.coalesce(F.bool_or(F.col(alpn) == token), F.lit(False)).alias("has_token")] if alpn else []
    more += [some(sni).alias("names")] if sni else []
    return headers.groupBy(*by).agg(some("version").alias("versions"), F.count_if("initial").alias("initials"), F.countDistinct("dcid").alias("connections"), *more)
