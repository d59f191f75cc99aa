"""Alignment of two tokenizers' tokens over the same bytes, and how often id pairs are linked across a corpus.

Each partition encodes its texts twice and gives DuckDB two interval tables, tokens of A and of B, on one byte axis for
a megabyte of documents. Where a token of A and one of B end together is a cut. Tokens that also begin together are a group;
for the others a window sum over the cuts numbers A's groups, an ASOF join takes each token of B to the first cut at or behind
its end, and a join on the group gives the links. A partition adds up in how many of its documents each pair of ids is linked; Spark merges these partial counts.

`aligned` gives each document's groups and id pairs, `rated` adds what the corpus-wide counts say about them. Counts
are joined to the documents' pairs in two parts: at most `BROADCAST_PAIRS` of the commonest pairs, which are most of all
rows, by broadcast, and the rest, however many there are, by shuffle. Both parts are always computed.

The text that A encodes is a space and the document's text, as B adds a space itself. A text is null, empty, or altered
by a tokenizer (joined token bytes differ): it has no tokens, all numbers are 0. Repeated rows count as documents of
their own, as do rows of equal or null identifiers. A document is encoded as a whole, so memory grows with the longest
text. An empty table gives no row. Columns other than identifier and text are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import Scratch, settle

SLICE_BYTES = 1_000_000  # of text in one set of interval tables
LARGE = 256  # links in a group from which equal ids are counted before the join
KEPT_PAIRS = 2_000_000  # partial counts that a partition holds before it gives them away
BROADCAST_PAIRS = 500_000
_BLOCK = 65_536  # partial counts in one row
_MOST = 200_000  # words with known ids

#: Tokens of both kinds with the same begin and end are groups of their own; what is left is grouped between cuts.
_ALIGN = """
CREATE OR REPLACE TEMP TABLE met AS
SELECT a.doc, a.id AS a, a.s, a.e, b.id AS b, b.s AS other FROM tokens_a a LEFT JOIN tokens_b b ON a.e = b.e;
CREATE OR REPLACE TEMP TABLE rest_a AS
SELECT doc, a AS id, e, hit, CAST(sum(hit) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - hit AS BIGINT) AS g
FROM (SELECT *, CAST(other IS NOT NULL AS INTEGER) AS hit FROM met WHERE other IS NULL OR other <> s);
CREATE OR REPLACE TEMP TABLE rest_b AS
SELECT b.id, b.e, cut.g FROM (SELECT id, e FROM tokens_b ANTI JOIN (SELECT e FROM met WHERE other = s) USING (e)) b
ASOF JOIN (SELECT e, g FROM rest_a WHERE hit = 1) cut ON b.e <= cut.e
"""
_LINK = """
CREATE OR REPLACE TEMP TABLE links AS
SELECT doc, a, b, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT doc, a, b, 1 AS n FROM met WHERE other = s
  UNION ALL SELECT doc, x.id, y.id, x.n * y.n FROM REST_A x JOIN REST_B y USING (g)) GROUP BY ALL
"""
_EACH = _LINK.replace("REST_A", "(SELECT *, 1 AS n FROM rest_a)").replace("REST_B", "(SELECT *, 1 AS n FROM rest_b)")
#: Where groups are large, equal ids of a group are counted before the join.
_COUNTED = _LINK.replace("REST_A", "(SELECT doc, g, id, count(*) AS n FROM rest_a GROUP BY ALL)").replace(
    "REST_B", "(SELECT g, id, count(*) AS n FROM rest_b GROUP BY ALL)"
)


class ByteLevel:
    """Byte-level BPE from a tokenizers file, run by tiktoken, whose ids are the file's as merges rank by id. It never alters a
    text: any bytes are made of its tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}
        special = {t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if i not in special}
        self.sizes = np.zeros(1 + max([*ranks.values(), *special]), dtype=np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self.library = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of a space and each text."""
        return [np.array(self.library.encode_ordinary(" " + t), dtype=np.int32) for t in texts]


class Pieces:
    """A sentencepiece model that adds a space itself. Where no piece joins over a space between other signs, texts whose spaces
    are all such are put together from their words, about _MOST of which are kept."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spelled = [
            bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode("utf-8")
            for i in range(m.get_piece_size())
        ]
        self.sizes = np.array([len(s) for s in self.spelled], dtype=np.int64)


        self.by_word = not any(b" " in s.lstrip(b" ") for s in self.spelled)
        self.known: dict[str, bytes] = {}
        self.special: set[str] = set()

    def _whole(self, text: str) -> np.ndarray | None:
        ids = self.library.encode(text)
        same = b"".join(map(self.spelled.__getitem__, ids)) == b" " + text.encode("utf-8")
        return np.array(ids, dtype=np.int32) if same else None

    def _learn(self, words: list[str]) -> None:
        """Ids of words as bytes. Special are words that begin with white space or are altered: their texts are encoded whole."""
        plain = [w for w in words if w and not w[0].isspace()]
        self.special.update(w for w in words if not w or w[0].isspace())
        made = self.library.encode(plain, num_threads=1)
        flat = np.fromiter(chain.from_iterable(made), dtype=np.int32, count=sum(map(len, made)))
        ends = np.cumsum([0, *map(len, made)])
        spelled = b"".join(map(self.spelled.__getitem__, flat.tolist()))
        lengths = np.append(0, np.cumsum(self.sizes[flat]))[ends]
        data, at = flat.tobytes(), (4 * ends).tolist()
        if spelled == b" " + " ".join(plain).encode("utf-8") and (np.diff(lengths) > 0).all():
            begins = np.frombuffer(spelled, dtype=np.uint8)[lengths[:-1]] == 32
            if begins.all():  # as many spaces as words, each where a word begins: no word is altered
                self.known.update(zip(plain, [data[lo:hi] for lo, hi in zip(at, at[1:], strict=False)], strict=True))
                return
        for w, ids, lo, hi in zip(plain, made, at, at[1:], strict=False):
            if b"".join(map(self.spelled.__getitem__, ids)) == b" " + w.encode("utf-8"):
                self.known[w] = data[lo:hi]
            else:
                self.special.add(w)

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of a space and each text; None where their bytes differ from it."""
        if not self.by_word:
            return list(map(self._whole, texts))
        words = [t.split(" ") for t in texts]
        met = set(chain.from_iterable(words))
        if len(self.known) > _MOST:
            self.known = {w: self.known[w] for w in met & self.known.keys()}
            self.special &= met
        if missing := list(met - self.known.keys() - self.special):
            self._learn(missing)
        return [
            np.frombuffer(b"".join(map(self.known.__getitem__, w)), dtype=np.int32) if self.special.isdisjoint(w) else self._whole(t)
            for t, w in zip(texts, words, strict=True)
        ]


_WORKER: dict = {}


def _encoders(path_a: str, path_b: str, pattern: str) -> tuple[ByteLevel, Pieces]:
    """One pair for all tasks of a Python worker."""
    key = path_a, path_b, pattern
    if key not in _WORKER:
        _WORKER[key] = ByteLevel(path_a, pattern), Pieces(path_b)
    return _WORKER[key]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(identifiers, texts) of about SLICE_BYTES each."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            if texts and size + len(text) > SLICE_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(text)
            size += len(text)
    if ids:
        yield ids, texts


def _names(n: int, after_a: str, last: str) -> np.ndarray:
    """Texts of ids 0 to n - 1 with the sign behind: first all with `after_a`, then all with `last`."""
    return np.array([f"{i}{sign}" for sign in (after_a, last) for i in range(n)], dtype=object)


def _ordered(table: pa.Table, by: str) -> pa.Table:
    """Sorted by a column that mostly is in order."""
    key = table[by].to_numpy()
    return table if (key[1:] >= key[:-1]).all() else table.take(pa.array(np.argsort(key, kind="stable")))


def _group_texts(a, ga, b, gb, names_a: np.ndarray, names_b: np.ndarray, ends: np.ndarray) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` for each document from ids and their groups: A's tokens of a group, then B's. ends: number of both
    kinds' tokens, and so of places, up to each document's end."""
    n = int(ga[-1]) + 1
    ends_a, ends_b = np.cumsum(np.bincount(ga, minlength=n)), np.cumsum(np.bincount(gb, minlength=n))
    out = np.empty(len(a) + len(b), dtype=object)
    last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    last_a[ends_a - 1] = last_b[ends_b - 1] = 1
    out[np.arange(len(a)) + np.concatenate([[0], ends_b])[ga]] = names_a[a + last_a * (len(names_a) // 2)]
    out[np.arange(len(b)) + ends_a[gb]] = names_b[b + last_b * (len(names_b) // 2)]
    places = out.tolist()
    return ["".join(places[lo:hi])[:-1] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """Rows with a `row` are documents: row (unique), identifier, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`)
    and pairs (a, b, n: links in this document). Rows without one are partial counts: pairs (a, b, n: documents).

    pattern: how A splits a text before merging; by default the pattern that the tokenizers' package gives."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    pair = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, _id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<struct<a:int,b:int,n:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        enc_a, enc_b = _encoders(path_a, path_b, pattern)
        names_a, names_b = _names(len(enc_a.sizes), ",", "|"), _names(len(enc_b.sizes), ",", ";")
        number = TaskContext.get().partitionId() << 33
        first = next(batches, None)
        if first is None:
            return
        id_type, names = first.schema.field(0).type, ["row", "_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"]
        db = duckdb.connect(config={"threads": 1})
        db.execute("CREATE TEMP TABLE pair_docs (a INTEGER, b INTEGER, n BIGINT)")

        def listed(table: pa.Table, bounds: np.ndarray) -> pa.Array:
            flat = pa.StructArray.from_arrays(
                [table[c].combine_chunks().cast(t) for c, t in (("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()))], ["a", "b", "n"]
            )
            return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat).cast(pair)

        def counts() -> Iterator[pa.RecordBatch]:
            held = db.sql("SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM pair_docs GROUP BY ALL").to_arrow_table()
            db.execute("DELETE FROM pair_docs")
            if held.num_rows:
                pairs = listed(held, np.append(np.arange(0, held.num_rows, _BLOCK), held.num_rows))
                none = [pa.nulls(len(pairs), t) for t in (pa.int64(), id_type, *[pa.int64()] * 4, pa.string())]
                yield pa.RecordBatch.from_arrays([*none, pairs], names)

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        held = 0
        for ids, texts in _texts(again()):
            n = len(ids)
            full = [k for k, t in enumerate(texts) if t]
            texts = [texts[k] for k in full]
            found = [(k, x, y) for k, x, y in zip(full, enc_a.encode(texts), enc_b.encode(texts), strict=True) if y is not None]
            numbers, groups, bounds = np.zeros((4, n), dtype=np.int64), [""] * n, np.zeros(n + 1, dtype=np.int64)
            pairs_table = pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "n")})
            if found:
                at = np.array([k for k, _, _ in found])
                sizes_a, sizes_b = np.array([len(x) for _, x, _ in found]), np.array([len(y) for _, _, y in found])
                a, b = np.concatenate([x for _, x, _ in found]), np.concatenate([y for _, _, y in found])
                ends_a, ends_b = np.cumsum(enc_a.sizes[a]), np.cumsum(enc_b.sizes[b])
                begins_a, begins_b = ends_a - enc_a.sizes[a], ends_b - enc_b.sizes[b]
                tokens_a = pa.table({"doc": np.repeat(at, sizes_a).astype(np.int32), "id": a, "s": begins_a, "e": ends_a})  # noqa: F841
                tokens_b = pa.table({"id": b, "s": begins_b, "e": ends_b})  # noqa: F841
                db.execute(_ALIGN)
                cuts = np.sort(db.sql("SELECT e FROM met WHERE other IS NOT NULL").to_arrow_table()["e"].to_numpy())
                group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
                each = np.bincount(group_a) * np.bincount(group_b)
                db.execute(_EACH if each.max() < LARGE else _COUNTED)
                db.execute("INSERT INTO pair_docs SELECT a, b, count(*) FROM links GROUP BY ALL")
                pairs_table = _ordered(db.sql("SELECT doc, a, b, n FROM links").to_arrow_table(), "doc")
                numbers[0][at], numbers[1][at] = sizes_a, sizes_b
                whole = np.cumsum(sizes_a) - 1  # each document's last token ends its last group
                numbers[2][at] = np.diff(group_a[whole] + 1, prepend=0)
                of = pairs_table["doc"].to_numpy()
                numbers[3] = np.bincount(of, weights=pairs_table["n"].to_numpy(), minlength=n)
                bounds = np.searchsorted(of, np.arange(n + 1))
                texts_of = _group_texts(a, group_a, b, group_b, names_a, names_b, np.cumsum(sizes_a + sizes_b))
                for k, text in zip(at.tolist(), texts_of, strict=True):
                    groups[k] = text
                held = db.sql("SELECT count(*) FROM pair_docs").fetchall()[0][0]
            rows = pa.array(np.arange(number, number + n))
            number += n
            columns = [rows, pa.array(ids, id_type), *map(pa.array, numbers), pa.array(groups, pa.string()), listed(pairs_table, bounds)]
            yield pa.RecordBatch.from_arrays(columns, names)
            if held > KEPT_PAIRS:
                yield from counts()
        yield from counts()

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)
    return out.withColumnRenamed("_id", id_col)


def rated(rows: DataFrame, most_broadcast: int = BROADCAST_PAIRS) -> DataFrame:
    """The document rows of `aligned`, without row and pairs, with n_best (links whose count is their A id's highest) and
    count_sum (counts of the pairs over all links). Read three times, so rows are written first."""
    with Scratch(rows.sparkSession) as scratch:
        made = scratch.keep(rows)
        partial = made.where("row is null").select(F.explode("pairs").alias("p")).select("p.*")
        counts = scratch.keep(partial.groupBy("a", "b").agg(F.sum("n").alias("docs")))
        most = counts.groupBy("a").agg(F.max("docs").alias("most"))
        counts = scratch.keep(counts.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best")))
        level = F.floor(F.log2("docs")).cast("int")
        levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()  # at most 63 rows
        least, total = None, 0
        for r in levels:
            total += r.n
            if total > most_broadcast:
                break
            least = r.level
        common = level >= least if least is not None else F.lit(False)
        links = made.where("row is not null").select("row", F.explode("pairs").alias("p")).select("row", "p.*")
        met = links.join(F.broadcast(counts.where(common)), ["a", "b"])
        if total > most_broadcast:
            rest = links.join(F.broadcast(counts.where(common).select("a", "b")), ["a", "b"], "left_anti")
            met = met.unionByName(rest.join(counts.where(~common).hint("merge"), ["a", "b"]))
        sums = met.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum")
        )
        whole = made.where("row is not null").drop("pairs").join(sums, "row", "left")
        return settle(whole.fillna(0, ["n_best", "count_sum"]).drop("row"))
