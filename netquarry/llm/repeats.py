"""Removal of long repeats: every byte covered by a string of `length` bytes that also starts somewhere else.

Anchor hashing, in place of a suffix sort by difference cover: nothing is ranked and nothing recurses. The anchors must
be a cover, like a sample of suffixes: wherever two equal strings of `length`
bytes start, both have a sampled suffix at the same offset. A difference cover of positions modulo v has that property
for any two positions, at a price of about 1.5 / sqrt(v) of all positions. Here equal strings only have to agree, so the
cover is taken from content: the position whose `GRAM` bytes have the least hash among all in the string. It has the
same property with about 0.7 % of all positions, and the sampled suffixes of different documents are in step.

1. Sample: the starts i of strings are split into runs with the same sampled suffix p(i) (`samples`). A run has a name
   for the `GRAM` bytes at p and one for its whole context, which is all the strings of the run.
2. Count names: runs are grouped by (gram, context). A context that occurs twice is repeated as a whole. A gram with a
   single context has no repeats. Counting is done before the shuffle, so copies of one text shrink there.
3. Only grams with several contexts are left (ends of repeats). One run of each context is taken along.
4. The remaining strings are sorted by a hash of the sampled suffix, the distance to it, and the bytes; equal neighbours
   are then compared byte by byte (`_repeated`). A gram with over `HOT` contexts is not gathered: its contexts are cut
   into pieces, which are named, counted and compared like contexts, and what stays unclear is cut again, down to single
   strings (`_narrowed`). Both ways find the same strings.
5. Repeats are merged to spans of each document and cut out.

Contexts are equal where a 64-bit hash of the gram and a 128-bit hash of the context are. Matches do not
cross documents. Null text is empty; texts of under `length` bytes have no repeats; texts over `PART` bytes are
sampled in overlapping parts. Rows that share identifier and text are copies like any other. Identifiers can be of any
type that Spark hashes, and null. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import Scratch, parts, settle, small

LENGTH = 400
GRAM = 96
PART = 1 << 22
HOT = 256  # contexts of a gram that are compared in one task
WIDTHS = (64, 8, 1)  # strings in a piece of a context, from cut to cut
BUFFER = 1 << 20  # bytes of contexts that are compared at a time
_U = np.uint64
class _Sums:
    """Polynomial hashes over random byte values."""

    def __init__(self, seed: int, base: int):
        self.bytes = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            step = np.full(size, self.base, dtype=np.uint64)
            step[0] = 1
            self.up = np.multiply.accumulate(step)
            step[1:] = self.back
            self.down = np.multiply.accumulate(step)

    def of(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of byte values times powers of the base."""
        self.powers(len(data) + 1)
        out = np.empty(len(data) + 1, dtype=np.uint64)
        out[0] = 0
        np.cumsum(self.bytes[data] * self.up[: len(data)], out=out[1:])
        return out

    def names(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[begin:end]."""
        return _mix((sums[end] - sums[begin]) * self.down[begin])


_FIRST = _Sums(9, 0x5851F42D4C957F2D)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def samples(data: np.ndarray, length: int, gram: int) -> tuple:
    """(first, last, sampled, gram name, context name) of the runs of string starts with one sampled suffix."""
    n = len(data) - length + 1
    if n <= 0:
        return (*(np.zeros(0, dtype=np.int64),) * 3, np.zeros(0, dtype=np.uint64), [])
    sums = _FIRST.of(data)
    at = np.arange(len(data) - gram + 1)
    name = _FIRST.names(sums, at, at + gram)
    key = (name >> _U(32)) << _U(32) | at.astype(np.uint64)
    # Least key of each `w` neighbours: from the parts of two blocks, each scanned once in either direction.
    w = length - gram + 1
    m = -(-len(key) // w) * w
    padded = np.full(m, 2**64 - 1, dtype=np.uint64)
    padded[: len(key)] = key
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    p = (least & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    p = p[first]
    whole, digest = data.tobytes(), xxhash.xxh3_128_digest
    shape = ((p - first) << 16 | (last - first)).tolist()
    context = [digest(whole[i : j + length], x) for i, j, x in zip(first.tolist(), last.tolist(), shape, strict=True)]
    return first, last, p, name[p], context


def _runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            contexts: list[bytes] = []
            for key, text_hash, data in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), strict=True):
                whole = np.frombuffer(data.as_py(), dtype=np.uint8)
                for at in range(0, max(1, len(whole) - length + 1), PART):
                    first, last, p, name, context = samples(whole[at : at + PART + length - 1], length, gram)
                    row = (np.full(len(p), key), np.full(len(p), text_hash), first + at, last + at, p + at, name.view(np.int64))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                    contexts += context
            columns = [pa.array(np.concatenate(c)) if c else pa.array([], pa.int64()) for c in out]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(contexts, pa.binary())], names)

    names = ["_id", "_text", "first", "last", "p", "gram", "context"]
    schema = "_id long, _text long, first long, last long, p long, gram long, context binary"
    return docs.select("_id", "_text", "data").mapInArrow(run, schema)


def _packed(docs: DataFrame) -> DataFrame:
    """(_id, _text, packed, id): texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in small(batches):
            data = pa.array([squeeze.compress(x.as_py()) for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data, batch.column(3)], ["_id", "_text", "packed", "id"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("_id", "_text", "data", "id").mapInArrow(run, f"_id long, _text long, packed binary, id {kind}")


def _unpack(packed: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed.as_py())


def _contexts(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted runs: (gram, want, _id, _text, first, ahead, context)."""
    lists = wanted.groupBy("_id", "_text").agg(F.collect_list(F.struct("gram", "want", "first", "last", "p")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[] for _ in range(7)]
            for key, text_hash, packed, runs in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), batch.column(3), strict=True):
                data = _unpack(packed)
                for r in runs.as_py():
                    first = r["first"]
                    row = (r["gram"], r["want"], key, text_hash, first, r["p"] - first, data[first : r["last"] + length])
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            types = [pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    names = ["gram", "want", "_id", "_text", "first", "ahead", "context"]
    schema = "gram long, want boolean, _id long, _text long, first long, ahead long, context binary"
    rows = _packed(docs).drop("id").join(lists, ["_id", "_text"])
    return rows.mapInArrow(run, schema)


def _windows(context: pa.Array, length: int) -> tuple[np.ndarray, ...]:
    """(bytes of all contexts, and of each string in them: row, start in the row's context, place in the bytes)."""
    sizes = np.array([len(x.as_buffer()) for x in context], dtype=np.int64)
    data = np.frombuffer(b"".join(x.as_py() for x in context), dtype=np.uint8)
    n = sizes - length + 1
    row = np.repeat(np.arange(len(n)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return data, row, start, np.repeat(np.cumsum(sizes) - sizes, n) + start


def _name(hashes: _Sums, data: np.ndarray, at: np.ndarray, offset: np.ndarray, gram: np.ndarray, length: int) -> np.ndarray:
    """Names of strings by their bytes, their distance to the sampled suffix, and the suffix's gram."""
    name = hashes.names(hashes.of(data), at, at + length)
    return _mix(name + offset.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _mix(gram.view(np.uint64)))


def _checked(found: np.ndarray, partner: np.ndarray, name: np.ndarray, data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """found, without the strings whose bytes are not those of any other string of equal name. Neighbours with
    neighbouring partners are compared as one piece."""
    k = np.flatnonzero(found)
    if not len(k):
        return found
    opens = np.ones(len(k), dtype=bool)
    opens[1:] = (np.diff(at[k]) != 1) | (np.diff(at[partner[k]]) != 1)
    i = np.flatnonzero(opens)
    whole = memoryview(data)
    for lo, hi in zip(i.tolist(), np.append(i[1:], len(k)).tolist(), strict=True):
        a, b = int(at[k[lo]]), int(at[partner[k[lo]]])
        n = hi - lo - 1 + length
        if whole[a : a + n] != whole[b : b + n]:
            for x in k[lo:hi].tolist():
                others = np.flatnonzero(name == name[x])
                found[x] = sum(whole[int(at[y]) : int(at[y]) + length] == whole[int(at[x]) : int(at[x]) + length] for y in others) > 1
    return found


def _repeated(table: pa.Table, length: int) -> pa.RecordBatch:
    """Spans of the wanted contexts whose strings occur twice in the table. It holds whole grams."""
    gram, ahead = table.column("gram").to_numpy(), table.column("ahead").to_numpy()
    data, row, start, place = _windows(table.column("context").combine_chunks(), length)
    name = _name(_FIRST, data, place, ahead[row] - start, gram[row], length)
    order = np.argsort(name, kind="stable")
    same = name[order][1:] == name[order][:-1]
    # Each string's partner is the first one of its name, and that one's partner is the second.
    head = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(name)), 0)) if len(name) else order
    partner = np.empty(len(name), dtype=np.int64)
    partner[order] = order[head]
    twice = np.flatnonzero(same & (head[:-1] == np.arange(len(name))[:-1])) if len(name) else order
    partner[order[twice]] = order[twice + 1]
    found = np.zeros(len(name), dtype=bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    found &= table.column("want").to_numpy(zero_copy_only=False)[row]
    at = np.flatnonzero(_checked(found, partner, name, data, place, length))
    opens = np.ones(len(at), dtype=bool)
    opens[1:] = (np.diff(at) > 1) | (np.diff(row[at]) > 0)
    i, j = at[opens], at[np.append(opens[1:], True)] if len(at) else at
    first = table.column("first").to_numpy()[row[i]]
    ids = [table.column(c).to_numpy()[row[i]] for c in ("_id", "_text")]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (*ids, first + start[i], first + start[j] + length)], ["_id", "_text", "begin", "end"])


_SPAN = "_id long, _text long, begin long, end long"


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of repeated strings; contexts of a gram are neighbours in a sorted partition and compared together."""

    def pieces(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole grams of about BUFFER bytes at a time."""
        gram = table.column("gram").to_numpy()
        opens = np.append(np.flatnonzero(np.diff(gram)) + 1, len(gram))
        upto = np.cumsum(pc.binary_length(table.column("context")).to_numpy())[opens - 1] // BUFFER
        ends = opens[np.append(np.diff(upto) > 0, True)].tolist()
        for i, j in zip([0, *ends], ends, strict=False):
            yield _repeated(table.slice(i, j - i), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows:
                gram = held.column("gram").to_numpy()
                cut = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on
                if cut:
                    yield from pieces(held.slice(0, cut))
                    held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield from pieces(held)

    dealt = contexts.repartition(parts(contexts.sparkSession), "gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, _SPAN)


def _pieces(contexts: DataFrame, length: int, width: int) -> DataFrame:
    """The contexts in pieces of at most `width` strings, the same distances to the sampled suffix in all contexts, with the
    hash `whole` of a piece. A piece's gram is a hash of what its strings have in common, and of the context's gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[] for _ in range(8)]
            for gram, want, key, text_hash, first, ahead, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                least = ahead - (len(context) - length)
                for k in range(least // width, ahead // width + 1):
                    low, high = max(k * width, least), min(k * width + width - 1, ahead)
                    piece = context[ahead - high : ahead - low + length]
                    common = context[ahead - k * width : ahead - (k + 1) * width + 1 + length]
                    name = xxhash.xxh3_64_intdigest(common, (gram ^ k * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
                    whole = xxhash.xxh3_128_digest(piece, high << 16 | (high - low))
                    row = (name - (name >> 63 << 64), want, key, text_hash, first + ahead - high, high, piece, whole)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            types = [pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    names = ["gram", "want", "_id", "_text", "first", "ahead", "context", "whole"]
    return contexts.mapInArrow(run, "gram long, want boolean, _id long, _text long, first long, ahead long, context binary, whole binary")


def _narrowed(contexts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """Spans of repeated strings, for grams with very many contexts: what is done with contexts is done with their pieces, from
    wide ones to single strings. Pieces that occur twice are repeated as a whole, pieces whose common bytes are in no
    other one hold no repeats, and few different ones are compared; only the others are cut again."""
    spans = []
    columns, place = contexts.columns, F.xxhash64("_id", "_text", "first")
    widths = [w for w in WIDTHS if 2 * w <= length or w == 1]
    for width in widths:
        rows = scratch.keep(_pieces(contexts, length, width))
        named = scratch.keep(rows.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one")))
        grams = named.groupBy("gram").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("contexts")).where("all > 1")
        grams = scratch.keep(grams)
        labelled = scratch.keep(rows.join(named.join(grams, "gram"), ["gram", "whole"]))
        scratch.drop(rows, named, grams)
        end = (F.col("first") + F.octet_length("context")).alias("end")
        spans.append(labelled.where("n > 1 and want").select("_id", "_text", F.col("first").alias("begin"), end))
        if width == widths[-1]:
            break
        left = labelled.where((F.col("contexts") > 1) & ((F.col("n") == 1) | (place == F.col("one"))))
        left = left.withColumn("want", F.col("want") & (F.col("n") == 1))
        spans.append(_compared(left.where(F.col("contexts") <= HOT).select(columns), length))
        contexts = left.where(F.col("contexts") > HOT).select(columns)
        if contexts.isEmpty():
            break
    return reduce(DataFrame.unionByName, spans)


def repeated_spans(docs: DataFrame, length: int, gram: int, scratch: Scratch) -> DataFrame:
    """(_id, _text, begin, end): byte ranges that together are the repeats, written. docs: (_id, _text, data, id).

    Tables that are joined on a gram are written before, so that adaptive execution splits a gram with very many runs."""
    runs = scratch.keep(_runs(docs, length, gram))
    # A text's own identity is (_id, _text); rows that share both are different places all the same. One run of each
    # context goes along with its gram, the one of the least hash; two of them do no harm.
    place = F.xxhash64("_id", "_text", "first")
    named = runs.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one"))
    named = scratch.keep(named)
    grams = named.groupBy("gram").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("contexts")).where("all > 1")
    grams = scratch.keep(grams)
    labelled = scratch.keep(runs.join(named.join(grams, "gram"), ["gram", "context"]))
    scratch.drop(runs, named, grams)
    whole = labelled.where("n > 1").select("_id", "_text", F.col("first").alias("begin"), (F.col("last") + length).alias("end"))
    chosen = (F.col("n") == 1) | (place == F.col("one"))
    left = labelled.where((F.col("contexts") > 1) & chosen).withColumn("want", F.col("n") == 1)
    spans = whole.unionByName(_compared(_contexts(left.where(F.col("contexts") <= HOT), docs, length), length))
    hot = left.where(F.col("contexts") > HOT)
    if not hot.isEmpty():
        # Written first, so that a task needs one Python worker at a time.
        spans = spans.unionByName(_narrowed(scratch.keep(_contexts(hot, docs, length)), length, scratch))
    spans = scratch.keep(spans)
    scratch.drop(labelled)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row: id, n_bytes, spans (removed byte ranges), kept (the remaining bytes)."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    # A row is told from others by hashes of identifier and text; rows of equal text have equal spans anyway.
    keyed = docs.select(F.xxhash64(id_col).alias("_id"), F.xxhash64(data).alias("_text"), data.alias("data"), F.col(id_col).alias("id"))
    with Scratch(docs.sparkSession) as scratch:
        spans = repeated_spans(keyed, length, gram, scratch)
        lists = settle(spans.groupBy("_id", "_text").agg(F.collect_list(F.struct("begin", "end")).alias("spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n_bytes, merged, kept = [], [], []
            for packed, spans in zip(batch.column(2), batch.column(4), strict=True):
                text = _unpack(packed)
                out: list[list[int]] = []
                for s in sorted(spans.as_py() or [], key=lambda s: (s["begin"], s["end"])):
                    if out and s["begin"] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], s["end"])
                    else:
                        out.append([s["begin"], s["end"]])
                edges = [0, *(x for s in out for x in s), len(text)]
                n_bytes.append(len(text))
                merged.append([{"begin": a, "end": b} for a, b in out])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            arrays = [pa.array(n_bytes, pa.int64()), pa.array(merged, span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(3), *arrays], ["id", "n_bytes", "spans", "kept"])

    rows = _packed(keyed).join(lists, ["_id", "_text"], "left")
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")
