"""Capture files of all kinds, hellos, and HTTP and QUIC heads against values worked out by hand."""

import hashlib
import struct

import pytest

from netquarry.functions import tls
from netquarry.operators import handshakes
from netquarry.sources import captures


def _ipv4(proto, body, extra=b""):
    total = 20 + len(body)
    return bytes([0x45, 0]) + struct.pack(">HHHBBH", total, 0, 0x4000, 64, proto, 0) + bytes([10, 0, 0, 1]) + bytes([10, 0, 0, 2]) + body + extra


TCP = struct.pack(">HHIIBBHHH", 1234, 443, 77, 0, 0x60, 0x18, 0, 0, 0) + b"opts" + b"hello"
UDP = struct.pack(">HHHH", 53, 5353, 11, 0) + b"dns"
ETHER = b"\x02" * 6 + b"\x04" * 6


def _file(path, packets, magic, link=1, cut=0):
    order, parts = captures.MAGIC[magic]
    out = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 262144, link)
    for seconds, fraction, data, length in packets:
        out += struct.pack(order + "IIII", seconds, int(fraction * parts), len(data), length) + data
    path.write_bytes(out[: len(out) - cut])


@pytest.mark.parametrize("magic", list(captures.MAGIC))
def test_byte_orders_stretches_and_cut_files(spark, tmp_path, magic):
    data = [(10 + k, 0.25, ETHER + b"\x08\x00" + _ipv4(6, TCP, b"pad"), 99) for k in range(20)]
    _file(tmp_path / "a.pcap", data, magic, cut=5)
    _file(tmp_path / "none.pcap", [], magic)
    for split in (1, 200, captures.SPLIT):
        rows = sorted(captures.read_captures(spark, str(tmp_path), split=split).collect(), key=lambda r: r.frame)
        assert [r.frame for r in rows] == list(range(1, 20))  # the last one is cut off
        r = rows[3]
        assert (r.ts, r.src, r.src_port, r.dst, r.dst_port, r.proto, r.length, r.seq, r.flags) == (13.25, "10.0.0.1", 1234, "10.0.0.2", 443, "tcp", 99, 77, 0x18)
        assert bytes(r.payload) == b"hello"  # options and padding aren't payload


def test_links_and_heads():
    six = bytes([0x60, 0, 0, 0]) + struct.pack(">HBB", len(UDP), 17, 64) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + UDP
    assert captures.parsed(ETHER + b"\x81\x00\x00\x05\x86\xdd" + six, 1) == ("::1", 53, "::2", 5353, "udp", None, None, b"dns")
    assert captures.parsed(_ipv4(17, UDP), 101)[:5] == ("10.0.0.1", 53, "10.0.0.2", 5353, "udp")
    assert captures.parsed(bytes(16) + _ipv4(1, b"ping"), 113) == ("10.0.0.1", None, "10.0.0.2", None, "icmp", None, None, b"ping")
    assert captures.parsed(ETHER + b"\x08\x06arp", 1)[0] is None and captures.parsed(b"", 1)[0] is None
    late = bytearray(_ipv4(17, UDP))
    late[6:8] = b"\x00\x10"  # a later fragment has no ports
    assert captures.parsed(bytes(late), 101)[1] is None


def test_not_a_capture(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"no capture at all, but long enough")
    with pytest.raises(Exception, match="not a capture"):
        captures.read_captures(spark, str(tmp_path)).collect()


def _hello(ciphers, extensions, sid=b"s" * 32):
    ext = b"".join(struct.pack(">HH", k, len(d)) + d for k, d in extensions)
    body = b"\x03\x03" + bytes(32) + bytes([len(sid)]) + sid + struct.pack(">H", 2 * len(ciphers)) + b"".join(struct.pack(">H", c) for c in ciphers)
    body += b"\x01\x00" + (struct.pack(">H", len(ext)) + ext if extensions else b"")
    return b"\x01" + len(body).to_bytes(3, "big") + body


def test_hello_fields_fingerprint_and_broken_ones(spark):
    alpn = b"\x02h2\x08http/1.1"
    ext = [(0x1A1A, b""), (0, b"\x00\x08\x00\x00\x05a.org"), (10, b"\x00\x06\x2a\x2a\x00\x1d\x00\x17"), (11, b"\x01\x00"), (16, struct.pack(">H", len(alpn)) + alpn), (35, b"")]
    hello = _hello([0x0A0A, 4865, 49195], ext)
    got = tls.client_hello(hello)
    text = "771,4865-49195,0-10-11-16-35,29-23,0"
    assert (got["server_name"], got["alpn"], got["ja3_string"], got["ja3"]) == ("a.org", ["h2", "http/1.1"], text, hashlib.md5(text.encode()).hexdigest())
    assert tls.client_hello(_hello([5], []))["ja3_string"] == "771,5,,,"
    assert tls.client_hello(hello[:60]) is None and tls.client_hello(b"\x01\x00\x00\x02\x03\x03") is None
    record = lambda d: b"\x16\x03\x01" + struct.pack(">H", len(d)) + d
    split = record(hello[:40]) + record(hello[40:])  # over two records, behind what isn't a record
    found = list(tls.client_hellos(b"\x16\x03\xff\x00" + split + b"rest" + record(_hello([7], [])), None))
    assert [(f["at"], f["ciphers"]) for f in found] == [(4, [0x0A0A, 4865, 49195]), (8 + len(split), [7])]
    far = bytes(9000) + record(hello)
    assert not list(tls.client_hellos(far)) and len(list(tls.client_hellos(far, None))) == 1
    df = spark.createDataFrame([(record(hello).hex(),), ("",), (None,), ("zz",)], "s string").select(tls.first_client_hello("s").alias("h"))
    assert [r.ja3 for r in df.select("h.ja3").collect()] == [got["ja3"], None, None, None]


def test_http_heads(spark):
    client = "GET /a HTTP/1.1\r\nHost: x\r\nUPGRADE: websocket\r\n\r\nPOST /b HTTP/1.0\nHost:y \n\nbody GET /no HTTP/1.1"
    server = "HTTP/1.1 101 Switching Protocols\r\nSec-WebSocket-Accept: k\r\n\r\n"
    df = spark.createDataFrame([("f", client, server), ("g", None, ""), ("h", "noise", "HTTP/1.1 204\r\n\r\n")], "flow string, c string, s string")
    records = handshakes.http_records(df, ["flow"], "c", "s")
    rows = {(r.flow, r.nth): r for r in records.collect()}
    assert set(rows) == {("f", 0), ("f", 1), ("h", 0)}
    assert (rows["f", 0].uri, rows["f", 0].upgrade, rows["f", 0].status, rows["f", 0].accept_key) == ("/a", "websocket", 101, "k")
    assert (rows["f", 1].method, rows["f", 1].host, rows["f", 1].status) == ("POST", "y", None) and rows["h", 0].status == 204
    one = handshakes.http_summary(records.where("flow = 'f'"), ["flow"], "/b").first()
    assert (one.requests, one.responses, one.upgrades, one.switched, one.uris, one.has_path) == (2, 1, 1, 1, ["/a", "/b"], True)


def test_quic_heads(spark):
    rows = [("c000000001" + "04aabbccdd" + "00" + "01",), ("d16b3343cf" + "00" + "02eeff",), ("c000000000" + "0000",), ("4000000001",), ("c000000001ff" + "00" * 40,), ("",), (None,)]
    got = sorted((r.version, r.dcid, r.scid, r.initial) for r in handshakes.quic_headers(spark.createDataFrame(rows, "d string"), "d").collect())
    assert got == [(1, "AABBCCDD", "", True), (0x6B3343CF, "", "EEFF", True)]
