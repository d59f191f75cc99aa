"""Toxicity scores by a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words and the first 3 to 6 bytes of each, hashed to 2**`BITS` buckets.
Over the labelled training rows a likelihood-ratio test keeps the `KEPT` buckets that tell most about the label; the
machine scores 1/(1 + exp(-(b + sum w_i + sum over pairs <v_i, v_j>))) over the kept buckets a document has, so a pair
of terms (an insult next to a mention of a group) can weigh more than both alone. Presence and not frequency counts,
so an insult weighs as much in a long document.

Only the fit is bounded: it sees about `TRAIN_ROWS` labelled rows, picked by a hash of their identifiers; these are
joined by broadcast, so documents are not shuffled. Every document is scored over its whole text.

Null and empty texts have no terms and get the bias's score. Labels that are null are not used; without labels of
both kinds the score is the smoothed share of label 1 for all. Repeated rows are scored alike. Other columns are not
looked at and pass `keep_below` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import words_of

BITS = 18
KEPT = 4096
LEAST_GAIN = 12.0  # of the log-likelihood ratio (G), about p < 0.001
TRAIN_ROWS = 24_000
RANK = 6
THRESHOLD = 0.7
AT_ONCE = 256  # documents whose pair vectors are in memory at a time; each has at most KEPT
_MOST = 300_000  # words that a worker remembers


def word_buckets(word: bytes) -> set[int]:
    """Buckets of a word and of its beginnings."""
    terms = [b"=" + word] + [b"^" + word[:n] for n in range(3, 7) if len(word) >= n]
    return {xxhash.xxh64_intdigest(t) & ((1 << BITS) - 1) for t in terms}


@dataclass
class Model:
    bias: float
    index: dict[int, int] = field(default_factory=dict)  # bucket -> row of weights
    linear: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK)))

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        """rows: the weight rows that each document has."""
        out = [np.zeros(0)]
        for at in range(0, len(rows), AT_ONCE):
            part = rows[at : at + AT_ONCE]
            n = np.array([len(r) for r in part], dtype=np.int64)
            flat = np.array([i for r in part for i in r], dtype=np.int64)
            out.append(1 / (1 + np.exp(-np.clip(_raw(self.bias, self.linear, self.pairs, n, flat)[0], -35, 35))))
        return np.concatenate(out)


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the next n[0], n[1], ... rows of values."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def _raw(bias, linear, pairs, n, flat):
    v = pairs[flat]
    s = _sums(v, n)
    return bias + _sums(linear[flat], n) + 0.5 * (s**2 - _sums(v**2, n)).sum(axis=1), s


def fit(rows: list[list[int]], labels: np.ndarray, kept: list[int], epochs: int = 30, seed: int = 11) -> Model:
    """Adagrad on the logistic loss with a little shrinkage, over documents in mixed order."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias, k = float(np.log(share / (1 - share))), len(kept)
    linear, pairs = np.zeros(k), rng.normal(0, 0.05, (k, RANK))
    gb, gl, gp = 1.0, np.ones(k), np.ones((k, RANK))
    for _ in range(epochs if k else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            part = order[at : at + 128]
            n = np.array([len(rows[i]) for i in part])
            flat = np.array([x for i in part for x in rows[i]], dtype=np.int64)
            raw, s = _raw(bias, linear, pairs, n, flat)
            miss = 1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[part]
            each = np.repeat(miss, n)
            dl = np.bincount(flat, weights=each, minlength=k) + 1e-3 * linear
            inner = each[:, None] * (np.repeat(s, n, axis=0) - pairs[flat])
            dp = np.stack([np.bincount(flat, weights=inner[:, r], minlength=k) for r in range(RANK)], axis=1)
            dp += 1e-3 * pairs
            db = miss.sum()
            gb, gl, gp = gb + db**2, gl + dl**2, gp + dp**2
            bias -= 0.3 * db / gb**0.5
            linear -= 0.3 * dl / np.sqrt(gl)
            pairs -= 0.05 * dp / np.sqrt(gp)
    return Model(bias, {b: i for i, b in enumerate(kept)}, linear, pairs)


class _Terms(dict):
    """word -> the weight rows of its buckets, remembered for up to _MOST words."""

    def __init__(self, index: dict[int, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = tuple(self.index[b] for b in word_buckets(word) if b in self.index)
        if len(word) <= 64:
            if len(self) >= _MOST:
                self.clear()
            self[word] = found
        return found

    def rows(self, text: str | None) -> list[int]:
        return sorted({i for found in map(self.__getitem__, set(words_of(text))) if found for i in found})


def _gain(n1: Column, n0: Column, all1: int, all0: int) -> Column:
    """Log-likelihood ratio of the label given the bucket against the label alone."""

    def term(k: Column, total: Column, share: float) -> Column:
        return F.when(k > 0, k * F.log(k / (total * F.lit(share)))).otherwise(0.0)

    p1, n, rest = all1 / (all1 + all0), n1 + n0, F.lit(float(all1 + all0)) - n1 - n0
    m1, m0 = F.lit(float(all1)) - n1, F.lit(float(all0)) - n0
    return 2 * (term(n1, n, p1) + term(n0, n, 1 - p1) + term(m1, rest, p1) + term(m0, rest, 1 - p1))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Fits on the rows of `labels` (which the caller has cut to its training fold)."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    total = known.count()
    share = -(-total // train_rows)
    picked = known.where(F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(max(1, share))) == 0)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(picked), "_id").select("_id", "_label", "_text")  # at most about train_rows labels

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), dtype=np.int64)
        seen = np.zeros(2, dtype=np.int64)
        for batch in batches:
            for label, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                n[label, np.fromiter(set().union(*map(word_buckets, set(words_of(text.as_py())))), dtype=np.int64)] += 1
                seen[label] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *at]), pa.array([seen[1], *n[1, at]]), pa.array([seen[0], *n[0, at]])], ["bucket", "n1", "n0"]
        )

    sums = rows.mapInArrow(count, "bucket long, n1 long, n0 long").groupBy("bucket")
    sums = sums.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).persist()
    both = sums.where("bucket = -1").first()
    all1, all0 = (both.n1, both.n0) if both else (0, 0)
    if not all1 or not all0:
        sums.unpersist()
        p = (all1 + 1) / (all1 + all0 + 2)
        return Model(float(np.log(p / (1 - p))))
    gains = sums.where("bucket >= 0").withColumn("gain", _gain(F.col("n1"), F.col("n0"), all1, all0))
    best = gains.where(F.col("gain") > LEAST_GAIN).orderBy(F.desc("gain"), "bucket").limit(KEPT)
    kept = sorted(r.bucket for r in best.select("bucket").collect())
    sums.unpersist()
    index = {b: i for i, b in enumerate(kept)}

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(index)
        for batch in batches:
            found = [terms.rows(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["_id", "_label", "rows"]
            )

    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, _label int, rows array<int>"
    got = rows.withColumn("_label", F.col("_label").cast("int")).mapInArrow(reduce, schema).collect()
    got.sort(key=lambda r: (r[0], r.rows))
    return fit([list(r.rows) for r in got], np.array([r._label for r in got], dtype=float), kept)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(shared.value.index)
        for batch in batches:
            found = shared.value.scores([terms.rows(t.as_py()) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["id", "score"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_below(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(shared.value.index)
        for batch in batches:
            found = shared.value.scores([terms.rows(t.as_py()) for t in batch.column(at)])
            yield batch.filter(pa.array(found < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: Column) -> Column:
    """The fold whose labels are never learned: crc32 of the identifier's text has remainder 1 by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))
