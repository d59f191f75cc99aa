"""An inverted-file index of vectors: cells round k-means centres, and searches that read few cells or prove themselves exact.

The centres are fitted on a bounded sample (`SAMPLE` rows, picked by a hash of the identifier); every row is assigned to its
nearest centre by angle. A cell is stored as blocks of about `BLOCK` rows, so a cell that holds a third of all rows is many
rows of the stored table and many tasks' work. What travels to every task is the matrix of centres, at most `MOST_CELLS`
rows.

A search reads the nearest cells of each query: as many as give the asked recall among the sample's own rows, where the ten
nearest are known by brute force (`reach`). An exact search goes on with every cell that could hold a better
row than the k-th found: no row of a cell is nearer to the query than the angle to its centre less the cell's widest angle.

Vectors that are null, empty, zero or of another length than most of the sample have no direction and are left out, as rows
and as queries. Equal vectors tie by identifier. Scores are cosines; ties are told at six decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from netquarry.durable import settle
from netquarry.operators.vector_search import best_places

SAMPLE = 16_384
MOST_CELLS = 4_096
BLOCK = 1_024
QUERY_BLOCK = 512
ASKED = 128  # queries whose cells are written in one batch: 128 x 4,096 cells at most, and as many vectors
STEPS = 12
MOST_BROADCAST = 100_000  # (query, cell) pairs whose vectors are broadcast, 100 MB at 128 dimensions; more are joined by shuffle


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the rows that have a direction in `dim` dimensions."""
    sizes = np.array([-1 if v is None else v for v in column.value_lengths().to_pylist()])
    at = np.flatnonzero(sizes == dim)
    if not len(at):
        return at, np.zeros((0, dim))
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt((flat * flat).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], flat[good] / norm[good, None]


def centres(vectors: np.ndarray, cells: int, steps: int = STEPS) -> np.ndarray:
    """Unit centres of unit vectors by k-means on the sphere; the first ones are spread over the rows' order."""
    c = vectors[np.linspace(0, len(vectors) - 1, min(cells, len(vectors))).astype(int)].copy()
    for _ in range(steps):
        near = (vectors @ c.T).argmax(axis=1)
        for j in range(vectors.shape[1]):
            c[:, j] = np.bincount(near, weights=vectors[:, j], minlength=len(c))
        norm = np.sqrt((c * c).sum(axis=1))
        empty = norm == 0
        c[~empty] /= norm[~empty, None]
        c[empty] = vectors[: empty.sum()]  # a cell that lost all its rows begins anew
    return np.unique(c, axis=0)


def reach(vectors: np.ndarray, c: np.ndarray, k: int = 10, most: int = 512) -> np.ndarray:
    """For the k nearest rows of up to `most` sample rows: how many cells must be read to meet each, in rising order."""
    cell = (vectors @ c.T).argmax(axis=1)
    asked = np.linspace(0, len(vectors) - 1, min(most, len(vectors))).astype(int)
    out = []
    for i in asked:
        s = vectors @ vectors[i]
        s[i] = -np.inf
        near = np.argpartition(-s, min(k, len(s)) - 1)[: min(k, len(s) - 1)]
        place = np.empty(len(c), dtype=np.int64)
        place[np.argsort(-(c @ vectors[i]), kind="stable")] = np.arange(1, len(c) + 1)
        out.append(place[cell[near]])
    return np.sort(np.concatenate(out)) if out else np.ones(1, dtype=np.int64)


class VectorIndex:
    """blocks: (cell, ids, vecs: the rows' unit vectors one behind the other), settled; wide: the widest angle of each cell."""

    def __init__(self, rows: DataFrame, id_col: str, vec_col: str, cells: int | None = None, sample: int = SAMPLE):
        spark = rows.sparkSession
        rows = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
        total = rows.count()
        some = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, total // sample))) == 0).where("size(vec) > 0").limit(2 * sample)
        got = some.orderBy(F.xxhash64("id"), "id").select("vec").toPandas()["vec"]
        sizes = np.array([len(v) for v in got]) if len(got) else np.zeros(1, dtype=int)
        self.dim = dim = max(1, int(np.bincount(sizes).argmax()))
        _, unit = _matrix(pa.array([v for v in got if len(v) == dim], pa.list_(pa.float64())), dim)
        wanted = cells or max(1, min(MOST_CELLS, round(len(unit) ** 0.5)))
        self.centres = centres(unit, wanted) if len(unit) else np.zeros((1, dim))
        self.reach = reach(unit, self.centres) if len(unit) > 1 else np.ones(1, dtype=np.int64)
        self.shared = shared = spark.sparkContext.broadcast(self.centres)
        self.kind = kind = rows.schema["id"].dataType
        id_type = to_arrow_type(kind)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = _matrix(batch.column(1), dim)
                sims = x @ shared.value.T
                cell = sims.argmax(axis=1) if len(x) else np.zeros(0, dtype=np.int64)
                angle = np.arccos(np.clip(sims[np.arange(len(x)), cell], -1, 1))
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(cell.astype(np.int32)), pa.array(angle), vec], ["id", "cell", "angle", "vec"])

        placed = settle(rows.mapInArrow(assign, f"id {kind.simpleString()}, cell int, angle double, vec array<double>"))
        self.wide = np.full(len(self.centres), -1.0)
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("wide"))  # a row for each cell
        sizes = settle(sizes)
        for r in sizes.collect():
            self.wide[r.cell] = r.wide
        dealt = placed.join(F.broadcast(sizes.select("cell", F.ceil(F.col("n") / BLOCK).alias("parts"))), "cell")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", "vec"), "parts")).groupBy("cell", "part")
        both = dealt.agg(F.collect_list(F.struct("id", "vec")).alias("r"))
        self.blocks = settle(both.select("cell", F.col("r.id").alias("ids"), F.flatten("r.vec").alias("vecs")))
        self.id_type = id_type

    def _asked(self, queries: DataFrame, id_type: pa.DataType, chosen) -> DataFrame:
        """(cell, q, qv) for each cell that chosen(angles to all centres, k-th score) names. queries: (q, vec, least)."""
        dim, shared = self.dim, self.shared
        kind = queries.schema["q"].dataType.simpleString()

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, ASKED) for b in batches for i in range(0, b.num_rows, ASKED)):  # a query may ask for every cell
                at, x = _matrix(batch.column(1), dim)
                angles = np.arccos(np.clip(x @ shared.value.T, -1, 1))
                least = batch.column(2).to_numpy(zero_copy_only=False)[at]
                row, cell = chosen(angles, least)
                vec = x[row]
                vecs = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * dim, pa.int32()), pa.array(vec.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0).take(pa.array(at[row])), vecs], ["cell", "q", "qv"])

        return queries.mapInArrow(ask, f"cell int, q {kind}, qv array<double>")

    def _scored(self, asked: DataFrame, queries: int, k: int, q_kind: str, q_type: pa.DataType) -> DataFrame:
        """(q, c, score): the k best rows of each block that is read for a query, itself left out."""
        asked = settle(asked)
        n = asked.count()
        deal = F.pmod(F.xxhash64("q"), F.lit(max(1, -(-queries // QUERY_BLOCK))))
        sets = asked.groupBy("cell", deal.alias("deal")).agg(F.collect_list(F.struct("q", "qv")).alias("r"))
        sets = sets.select("cell", F.col("r.q").alias("qs"), F.flatten("r.qv").alias("qvs"))
        met = self.blocks.join(F.broadcast(sets) if n <= MOST_BROADCAST else sets.hint("merge"), "cell").select("ids", "vecs", "qs", "qvs")
        dim, id_type = self.dim, self.id_type

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, qs = (batch.column(c)[i].values for c in (0, 2))
                    x, y = (batch.column(c)[i].values.to_numpy().reshape(-1, dim) for c in (1, 3))
                    s = np.round(y @ x.T, 6)
                    names = ids.to_pylist()
                    own = {c: j for j, c in enumerate(names)}
                    for r, q in enumerate(qs.to_pylist()):
                        if q in own:
                            s[r, own[q]] = -np.inf
                    least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -2.0)
                    row, col = np.nonzero((s >= least[:, None]) & (s > -2))
                    ties = pc.rank(ids, tiebreaker="first").to_numpy()[col]
                    at, _ = best_places(row, s[row, col], ties, k)
                    row, col = row[at], col[at]
                    yield pa.RecordBatch.from_arrays([qs.take(pa.array(row)), ids.take(pa.array(col)), pa.array(s[row, col])], ["q", "c", "score"])

        found = met.mapInArrow(score, f"q {q_kind}, c {self.kind.simpleString()}, score double")
        w = Window.partitionBy("q").orderBy(F.desc("score"), F.col("c").asc_nulls_last())
        return settle(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))

    def search(self, queries: DataFrame, id_col: str, vec_col: str, k: int, recall: float = 0.92, exact: bool = False) -> DataFrame:
        """(q, c, score, rank): the k nearest rows of each query, but for the row with the query's own identifier."""
        q = queries.select(F.col(id_col).alias("q"), F.col(vec_col).alias("vec"))
        q_field = q.schema["q"].dataType
        args = q.count(), k, q_field.simpleString(), to_arrow_type(q_field)
        probes = int(self.reach[min(len(self.reach) - 1, int(np.ceil(recall * len(self.reach))))])

        def nearest(angles: np.ndarray, _) -> tuple[np.ndarray, np.ndarray]:
            cells = np.argsort(angles, axis=1, kind="stable")[:, :probes]
            return np.repeat(np.arange(len(angles)), probes), cells.ravel()

        first = self._scored(self._asked(q.withColumn("least", F.lit(None).cast("double")), args[3], nearest), *args)
        if not exact or probes == len(self.centres):
            return first
        wide = self.wide

        def possible(angles: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            bound = np.cos(np.clip(angles - wide[None, :], 0, np.pi))
            more = (wide[None, :] >= 0) & ~(bound < np.where(np.isnan(least), -2, least)[:, None] - 2e-6)
            np.put_along_axis(more, np.argsort(angles, axis=1, kind="stable")[:, :probes], False, axis=1)
            return np.nonzero(more)

        kth = first.where(F.col("rank") == k).select(F.col("q").alias("_q"), F.col("score").alias("least"))
        again = q.join(kth, F.col("q").eqNullSafe(F.col("_q")), "left").select("q", "vec", "least")
        more = self._scored(self._asked(again, args[3], possible), *args)
        w = Window.partitionBy("q").orderBy(F.desc("score"), F.col("c").asc_nulls_last())
        both = first.drop("rank").unionByName(more.drop("rank")).withColumn("rank", F.row_number().over(w))
        return both.where(F.col("rank") <= k)
