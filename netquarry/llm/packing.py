"""Best-fit packing: documents into as few sequences of a fixed number of tokens as a length histogram allows.

A plan is made in length space, so its size depends on the sequence length and not on the number of documents:

1. patterns of few documents that fill a sequence are enumerated from the histogram's lengths (`patterns`);
2. non-negative least squares fits how often to repeat each pattern so that the histogram is met (`fit`);
3. repeat counts are rounded (and cut to what the histogram still has); what is left is fitted again, a few times, and the
   residual lengths, longest first, go to the open sequences where they fit best, whole classes of equal sequences at a
   time (`plan`).

Spark then numbers the documents of each length (salted, so a length that holds a third of all rows is many tasks'
work) and joins them with the plan's slots. Only the histogram (at most `width` rows) comes to the driver and only
the plan goes back; a plan of over `BROADCAST_ROWS` slots is joined by shuffle.

Null and empty texts have just the end token. A text of more than `width` tokens is cut into full pieces, the last
may be shorter. Repeated rows are packed as often as they come. Other columns are not looked at.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import parts, ranked, settle

BROADCAST_ROWS = 200_000
COMPANY = 5  # lengths that stand for all, as many documents being between each and the next
SPLITS = 5  # documents that share the room beside a length and its company
SLACK = 64  # a pattern whose missing lengths are replaced by shorter ones may leave one part in so many of its room
ROUNDS = 8  # fits, each of what the ones before have left over
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize(docs: DataFrame, path: str, width: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 of its ids as little-endian unsigned 32-bit."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from netquarry.llm.word_tokens import WordEncoder

        encoder = _encoder(WordEncoder, path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encoder.encode(text.as_py()) + end
                for k in range(-(-len(data) // (4 * width))):
                    part = data[4 * width * k : 4 * width * (k + 1)]
                    for column, x in zip(out, (doc_id, k, width * k, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _PIECES)


_ENCODERS: dict = {}


def _encoder(kind, path: str):
    """One encoder for all tasks of a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = kind(path)
    return _ENCODERS[path]


def patterns(lengths: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Rows of up to 3 + SPLITS lengths (padded with 0) that leave little room in a sequence.

    Each length is enumerated alone, beside each of COMPANY lengths that stand for all documents (quantiles), and beside
    each two of them, as far as they fit. The room that is left is shared by 1, 2, ... SPLITS documents: each takes the
    longest length within an equal share of it, and the last one the longest that still fits."""
    share = np.cumsum(counts) / counts.sum()
    few = np.unique(lengths[np.searchsorted(share, (np.arange(COMPANY) + 0.5) / COMPANY)])
    company = [(0, 0), *((0, x) for x in few), *((x, y) for x in few for y in few if x <= y)]
    rows = np.column_stack([np.repeat(lengths, len(company)), np.tile(np.array(company), (len(lengths), 1))])
    room = width - rows.sum(axis=1)
    rows, room = rows[room >= 0], room[room >= 0]
    with_0 = np.concatenate([[0], lengths])
    out = []
    for n in range(1, SPLITS + 1):
        each = with_0[np.searchsorted(lengths, room // n, side="right")]
        last = with_0[np.searchsorted(lengths, room - each * (n - 1), side="right")]
        equal = np.where(np.arange(SPLITS - 1) < n - 1, each[:, None], 0)
        out.append(np.column_stack([rows, equal, last]))
    return np.unique(-np.sort(-np.concatenate(out), axis=1), axis=0)


def fit(shapes: np.ndarray, counts: np.ndarray, steps: int = 120) -> np.ndarray:
    """Repeat counts x >= 0 that make the sum of (A x - counts)^2 / counts least, A holding how often each shape has
    each length. A miss is weighed by the count, so rare lengths are met as well as common ones.

    Multiplicative updates x <- x * A'Wh / A'WAx keep x non-negative and need A's few entries only."""
    col, place = np.nonzero(shapes)
    row = shapes[col, place]
    n = len(shapes)
    weight = 1 / np.maximum(counts, 0.5)
    target = np.bincount(col, weights=(weight * counts)[row], minlength=n)
    x = np.full(n, counts.sum() / max(1, len(row)))
    for _ in range(steps):
        made = weight * np.bincount(row, weights=x[col], minlength=len(counts))
        x *= target / np.maximum(np.bincount(col, weights=made[row], minlength=n), 1e-12)
    return x


def rounded(x: np.ndarray) -> np.ndarray:
    """Whole numbers whose running sums are those of x rounded: neighbours share what rounding takes from each."""
    return np.diff(np.floor(np.cumsum(x) + 0.5), prepend=0).astype(np.int64)


def _fitted(left: np.ndarray, width: int, level: int, opened: dict[int, dict[tuple[int, ...], int]]) -> None:
    """Fits patterns to what is left of the histogram and opens sequences for them, taking their lengths off `left`.

    Repeat counts are rounded by running sums first. Where lengths are rare, most counts are fractions of one, and patterns
    that share a length can't all be taken: from level 1 on those still possible are taken by falling count, each rounded up, and
    at level 2 once more with the next shorter lengths in place of those that are gone, as long as little room is left."""
    lengths = np.flatnonzero(left[:width])
    if not len(lengths):
        return
    counts = left.astype(float)
    shapes = patterns(lengths, counts[lengths], width)
    shapes = shapes[np.lexsort((*shapes.T, -shapes.sum(axis=1)))]  # fullest first
    x = fit(shapes, counts)
    repeats = rounded(x)
    order = [k for k in np.argsort(-x, kind="stable").tolist() if x[k] > 1e-6]

    def take(shape: tuple[int, ...], n: int) -> bool:
        for length in set(shape):
            n = min(n, int(left[length]) // shape.count(length))
        if n:
            for length in shape:
                left[length] -= n
            opened[width - sum(shape)][shape] += n
        return n > 0

    lots = [(k, int(repeats[k])) for k in np.flatnonzero(repeats).tolist()]
    for k, n in lots + [(k, int(np.ceil(x[k]))) for k in order if level]:
        take(tuple(v for v in shapes[k].tolist() if v), n)
    there = np.flatnonzero(left[:width]).tolist()
    for k in order if level == 2 else ():
        shape = []
        for v in shapes[k].tolist() if there else ():  # the longest that is left and no longer than the pattern's
            at = bisect.bisect_right(there, v) - 1
            while v and at >= 0 and left[there[at]] <= shape.count(there[at]):
                if not left[there[at]]:
                    there.pop(at)
                at -= 1
            if v and at >= 0:
                shape.append(there[at])
        if len(shape) > 1 and width - sum(shape) <= width // SLACK:
            take(tuple(shape), 1)


def plan(histogram: dict[int, int], width: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences) that use up the histogram. The more is placed by the fit the better, but
    if that costs sequences over the least possible number, plans that leave more to the best fit are made too, and the one of
    fewest sequences is taken."""
    least = -(-sum(length * n for length, n in histogram.items()) // width)
    best, fewest = None, None
    for level in (2, 1, 0):
        made = _planned(histogram, width, level)
        size = sum(n for _, n in made)
        if best is None or size < fewest:
            best, fewest = made, size
        if fewest <= least:
            break
    return best


def _planned(histogram: dict[int, int], width: int, level: int) -> list[tuple[tuple[int, ...], int]]:
    counts = np.zeros(width + 1)
    for length, n in histogram.items():
        counts[length] = n
    done: list[tuple[tuple[int, ...], int]] = [((width,), int(counts[width]))] if counts[width] else []
    left = counts.astype(np.int64)
    left[width] = 0
    opened: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))  # by the room left
    for _ in range(ROUNDS if level else 1):
        before = int(left.sum())
        _fitted(left, width, level, opened)
        if before - int(left.sum()) <= before // 50:
            break
    rooms = sorted(opened)
    for length in range(width - 1, 0, -1):
        while n := int(left[length]):
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                each = min(n, width // length)
                room, shape, m = width - each * length, (length,) * each, n // each
            else:
                room = rooms[k]
                shape, have = next(iter(opened[room].items()))
                each = min(n, room // length)
                m = min(have, n // each)
                opened[room][shape] -= m
                if not opened[room][shape]:
                    del opened[room][shape]
                if not opened[room]:
                    del rooms[k], opened[room]
                room, shape = room - each * length, shape + (length,) * each
            left[length] -= m * each
            if room not in opened:
                bisect.insort(rooms, room)
            opened[room][shape] += m
    return done + [(s, n) for r in sorted(opened) for s, n in opened[r].items()]


def _slots(shapes: list[tuple[tuple[int, ...], int]]) -> pa.Table:
    """For each place in a shape: the ranks, among documents of its length, that go there."""
    used: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int]] = []
    base = 0
    for shape, n in shapes:
        offset = 0
        for length in shape:
            rows.append((length, used[length], n, base, offset))
            used[length] += n
            offset += length
        base += n
    names = ["length", "first", "n", "base", "offset"]
    return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=names)


def pack(pieces: DataFrame, width: int) -> DataFrame:
    """Adds sequence_id and offset to (doc_id, piece, length, ...). pieces is settled first, as it is read twice."""
    spark = pieces.sparkSession
    pieces = settle(pieces)
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = _slots(plan(histogram, width))
    n = parts(spark)
    numbered = ranked(pieces, ["length"], ["doc_id", "piece"], F.xxhash64("doc_id", "piece"), n, "_rank")
    # A length's slots are numbered in blocks, so that rank -> slot is an equi-join on (length, block).
    block = max(1, -(-max(histogram.values(), default=1) // 256))
    slots = spark.createDataFrame(table.to_pandas(), "length long, first long, n long, base long, offset long")
    slots = slots.withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("n") - 1) / block)))
    )
    if table.num_rows <= BROADCAST_ROWS:
        slots = F.broadcast(slots)
    inside = (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("first") + F.col("n"))
    placed = numbered.withColumn("_block", F.floor(F.col("_rank") / block)).join(slots, ["length", "_block"]).where(inside)
    return placed.select(
        *pieces.columns, (F.col("base") + F.col("_rank") - F.col("first")).alias("sequence_id"), "offset"
    )
