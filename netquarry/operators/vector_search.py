"""Exact vector search of a query set over all rows: a grid of query groups and row slices, matrix products in each cell.

Both sides are dealt by hash, `GROUP` queries to a group and as many slices as make enough tasks; rows travel once for each
group. A task holds one group and meets the slice's rows in pieces of `PIECE`, so what it holds grows with neither side, and
gives back the k best of each query in its slice. The work grows with queries times rows, as each is asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

GROUP = 2_048
PIECE = 2_048
SLICE = 131_072
LEAST_TASKS = 48


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as SQL rounds."""
    return np.trunc(x * 10.0**digits + np.copysign(0.5, x)) / 10.0**digits


def best_places(row: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the candidates are the k best of their row (score down, then order), and their place there from 0."""
    at = np.lexsort((order, -score, row))
    place = np.arange(len(at)) - np.searchsorted(row[at], row[at])
    return at[place < k], place[place < k]


class Best:
    """The k best scores so far of each of n queries, to pass over what can't be among them."""

    def __init__(self, n: int, k: int, digits: int):
        self.held, self.k, self.digits = np.full((n, k), -np.inf), k, digits

    def pick(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, column, rounded score), at most k a query, of scores by query and column; columns are in the order of ties."""
        least = self.held.min(axis=1)
        if s.shape[1] > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(s, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero((s >= least[:, None] - 10.0**-self.digits) & (s > -np.inf))
        score = rounded(s[row, col], self.digits)
        at, place = best_places(row, score, col, self.k)
        row, col, score = row[at], col[at], score[at]
        new = np.full(self.held.shape, -np.inf)
        new[row, place] = score
        self.held = np.partition(np.concatenate([self.held, new], axis=1), self.k, axis=1)[:, self.k :]
        return row, col, score


def _by_length(column: pa.Array, unit: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (places, vectors) of a column of arrays; vectors with a null or no direction are zeros."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        norm = np.sqrt((x * x).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        out[d] = at, np.where(good[:, None], x / np.where(good, norm, 1.0)[:, None] if unit else x, 0.0)
    return out


def nearest_rows(queries: DataFrame, rows: DataFrame, id_col: str, vec_col: str, k: int, digits: int = 6, unit: bool = True, before: bool = False) -> DataFrame:
    """(q, c, score, rank), with `before` also met: the k best rows of each query by cosine (dot product without `unit`), but for those with the
    query's own identifier; of equal scores the lower identifier first. `before` compares only rows with a lower identifier
    than the query's; met is how many were compared. Vectors that are null, zero or of another length score 0.
    Identifiers of both sides have one type."""
    q = queries.select(F.col(id_col).alias("q"), F.col(vec_col).alias("vec"))
    c = rows.select(F.col(id_col).alias("c"), F.col(vec_col).alias("vec"))
    groups = max(1, -(-q.count() // GROUP))
    slices = max(1, -(-c.count() // SLICE), -(-LEAST_TASKS // groups))
    deal = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = q.select(deal("q", groups).alias("g"), every(slices).alias("s"), F.lit(0).alias("side"), "q", F.lit(None).cast(c.schema["c"].dataType).alias("c"), "vec")
    met = c.select(every(groups).alias("g"), deal("c", slices).alias("s"), F.lit(1).alias("side"), F.lit(None).cast(q.schema["q"].dataType).alias("q"), "c", "vec")
    cells = asked.unionByName(met).repartition(groups * slices, "g", "s").sortWithinPartitions("g", "s", "side")
    kinds = [q.schema["q"].dataType, c.schema["c"].dataType]
    types = [to_arrow_type(kinds[0]), to_arrow_type(kinds[1]), pa.float64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, group, found = None, [], None, []

        def opened():
            both = pa.concat_arrays([x for x, _ in asked])
            vectors: dict[int, tuple[list, list]] = {}
            start = 0
            for x, by in asked:
                for d, (at, v) in by.items():
                    places, held = vectors.setdefault(d, ([], []))
                    places.append(at + start)
                    held.append(v)
                start += len(x)
            return both, {d: (np.concatenate(p), np.concatenate(v)) for d, (p, v) in vectors.items()}, Best(len(both), k, digits), np.zeros(len(both), dtype=np.int64)

        def closed():
            if not found:
                return
            row, score = (np.concatenate([f[i] for f in found]) for i in (0, 2))
            ids = pa.concat_arrays([f[1] for f in found])
            at, _ = best_places(row, score, pc.rank(ids, tiebreaker="dense").to_numpy(), k)
            columns = [group[0].take(pa.array(row[at])), ids.take(pa.array(at)), pa.array(score[at]), pa.array(group[3][row[at]]), pa.array(np.full(len(at), cell[1]))]
            yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(columns, types, strict=True)], ["q", "c", "score", "met", "slice"])

        def meet(ids: pa.Array, vecs: pa.Array) -> None:
            qs, vectors, best, seen = group
            order = pc.sort_indices(ids)
            ids, vecs = ids.take(order), vecs.take(order)
            ranks = pc.rank(pa.concat_arrays([ids, qs.cast(ids.type)]), tiebreaker="dense").to_numpy().astype(np.int64)
            own, mine = ranks[: len(ids)], ranks[len(ids) :]
            low, high = np.searchsorted(own, mine, "left"), np.searchsorted(own, mine, "right")
            s = np.zeros((len(qs), len(ids)))
            for d, (at, x) in _by_length(vecs, unit).items():
                if d in vectors:
                    places, y = vectors[d]
                    if len(places) == s.shape[0] and len(at) == s.shape[1]:
                        s[places] = y @ x.T
                    else:
                        s[np.ix_(places, at)] = y @ x.T
            if before:
                seen += low
                s[np.arange(len(ids))[None, :] >= low[:, None]] = -np.inf
            else:
                seen += len(ids) - (high - low)
                for i in np.flatnonzero(high > low):
                    s[i, low[i] : high[i]] = -np.inf
            row, col, score = best.pick(s)
            if len(row):
                found.append((row, ids.take(pa.array(col)), score))

        for batch in batches:
            g, s, side = (batch.column(i).to_numpy() for i in range(3))
            marks = np.flatnonzero((np.diff(g) != 0) | (np.diff(s) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *marks], [*marks, len(g)], strict=True):
                if (g[lo], s[lo]) != cell:
                    yield from closed()
                    cell, asked, group, found = (g[lo], s[lo]), [], None, []
                part = batch.slice(lo, hi - lo)
                if side[lo] == 0:
                    asked.append((part.column(3), _by_length(part.column(5), unit)))
                elif asked:
                    group = group or opened()
                    for at in range(0, part.num_rows, PIECE):
                        meet(part.column(4).slice(at, PIECE), part.column(5).slice(at, PIECE))
        yield from closed()

    made = cells.mapInArrow(run, f"q {kinds[0].simpleString()}, c {kinds[1].simpleString()}, score double, met long, slice int")
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.col("c").asc_nulls_last())
    counted = made.groupBy("q", "slice").agg(F.first("met").alias("met")).groupBy("q").agg(F.sum("met").alias("met")) if before else None
    best = made.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("met", "slice")
    return best.join(counted, "q") if before else best
