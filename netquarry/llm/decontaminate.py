"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A window is `size` consecutive words of a benchmark item (a shorter item is one window). A document holds a window
only if it holds all the window's shingles (pairs of neighbouring words; a one-word window is its own shingle), so
with shingles ordered by rarity over all documents the necessary prefix is each window's rarest one. Documents are
joined on these, a candidate must leave room for the window's words before and after the shingle (position and
length bounds), and then the words are compared one by one over the whole window.

Windows are taken in blocks of about `BLOCK` windows, so memory doesn't grow with the benchmark: a block's index is
built on the driver and broadcast, the documents pass it without a shuffle, and where there are several blocks what is
found is written and the broadcast destroyed before the next block. A benchmark of one block needs one pass.

Null and wordless texts hold nothing; null, wordless and repeated benchmark items are allowed. Items without an
identifier can't be named in a result and are left out of the benchmark. Repeated document
rows are judged one by one. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import Scratch, settle, words_of

BLOCK = 50_000
SIZE = 10


def _shingles(words) -> list[tuple[bytes, ...]]:
    return list(zip(words, words[1:], strict=False)) if len(words) > 1 else [tuple(words)]


def windows(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(block, item_id, window) rows, words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for w in {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else ():
                    ids.append(item)
                    found.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], ["item", "window"])

    items = benchmark.select(F.col(id_col).cast("string"), F.col(text_col))
    return items.mapInArrow(run, "item string, window binary").where("item is not null").distinct()


def _document_frequency(docs: DataFrame, text_col: str, shingles: set) -> dict:
    """In how many documents each of these shingles is; counted in each partition before the shuffle."""
    wanted = docs.sparkSession.sparkContext.broadcast(shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = defaultdict(int)
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                for s in wanted.value.intersection(zip(words, words[1:], strict=False)):
                    counts[s] += 1
                for w in words[:1] if len(words) == 1 else ():
                    counts[(w,)] += (w,) in wanted.value
        keys = pa.array([b" ".join(k) for k in counts], pa.binary())
        yield pa.RecordBatch.from_arrays([keys, pa.array(counts.values(), pa.int64())], ["shingle", "n"])

    rows = docs.select(text_col).mapInArrow(run, "shingle binary, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {tuple(bytes(r.shingle).split(b" ")): r.n for r in rows.collect()}


def _index(rows: list, frequency: dict) -> dict:
    """Rarest shingle -> [(its place in the window, window, item ids)]."""
    items = defaultdict(set)
    for r in rows:
        items[bytes(r.window)].add(r.item)
    index = defaultdict(list)
    for window, ids in items.items():
        words = window.split(b" ")
        places = _shingles(words)
        at = min(range(len(places)), key=lambda k: (frequency.get(places[k], 0), places[k], k))
        index[places[at]].append((at, words, sorted(ids)))
    return dict(index)


def scan(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """Word spans of `index`'s windows in `words`, and their items."""
    spans, items = [], set()
    if len(words) > 1:
        places = [i for i, p in enumerate(zip(words, words[1:], strict=False)) if p in index]
    else:
        places = []
    candidates = [(i, c) for i in places for c in index[(words[i], words[i + 1])]]
    single = index.keys() & {(w,) for w in set(words)} if any(len(k) == 1 for k in index) else ()
    candidates += [(i, c) for i, w in enumerate(words) if (w,) in single for c in index[(w,)]] if single else []
    for i, (at, window, ids) in candidates:
        begin = i - at
        if begin >= 0 and begin + len(window) <= len(words) and words[begin : begin + len(window)] == window:
            spans.append((begin, begin + len(window)))
            items.update(ids)
    return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _indexes(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text_col: str, size: int = SIZE, item_id: str = "item_id", item_text: str = "text"):
    """(broadcast index of a block of windows, whether it is the only one), one after the other."""
    made = scratch.keep(windows(benchmark, size, item_id, item_text))
    blocks = -(-made.count() // BLOCK)
    for k in range(blocks):
        rows = made.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).collect()
        shingles = {s for r in rows for s in _shingles(bytes(r.window).split(b" "))}
        yield docs.sparkSession.sparkContext.broadcast(_index(rows, _document_frequency(docs, text_col, shingles))), blocks == 1


_FOUND = "n_words long, spans array<struct<begin:long,end:long>>, items array<string>"


def _scanned(rows: DataFrame, index, found_only: bool) -> DataFrame:
    """rows (..., text), the text replaced by n_words, spans and items; only rows with spans if found_only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in batch.column(batch.num_columns - 1):
                words = words_of(text.as_py())
                found = scan(words, index.value) if index else ([], ())
                n_words.append(len(words))
                spans.append([{"begin": a, "end": b} for a, b in _merged(found[0])])
                items.append(sorted(found[1]))
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            made = [pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "n_words", "spans", "items"])
            yield out.filter(pa.array([bool(s) for s in spans], pa.bool_())) if found_only else out

    kinds = "".join(f"`{c}` {t}, " for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, kinds + _FOUND)


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_words, spans (merged, in words, end exclusive), items (sorted)."""
    with Scratch(docs.sparkSession) as scratch:
        found = []
        # A row is told from others by hashes of identifier and text; rows of equal text have equal hits anyway.
        keys = [F.xxhash64(id_col).alias("_row"), F.xxhash64(F.lit(1), text_col).alias("_text")]
        for index, only in _indexes(docs, benchmark, scratch, text_col, **options):
            if only:
                return _scanned(docs.select(id_col, text_col), index, False)
            found.append(scratch.keep(_scanned(docs.select(*keys, text_col), index, True)))
            index.destroy()
        if not found:
            return _scanned(docs.select(id_col, text_col), None, False)
        all_found = found[0]
        for more in found[1:]:
            all_found = all_found.unionByName(more)
        sums = all_found.groupBy("_row", "_text").agg(F.collect_set("spans").alias("_spans"), F.collect_set("items").alias("_items"))
        sums = settle(sums)
    rows = _scanned(docs.select(id_col, *keys, text_col), None, False).drop("spans", "items").join(sums, ["_row", "_text"], "left")
    spans = F.array_sort(F.coalesce(F.flatten("_spans"), F.expr("array()")))
    last = lambda out: F.element_at(out, -1)
    merged = F.aggregate(
        spans,
        F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)"),
        lambda out, s: F.when((F.size(out) > 0) & (s["begin"] <= F.get(out, F.size(out) - 1)["end"]),
                              F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last(out)["begin"].alias("begin"), F.greatest(last(out)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(out, F.array(s))),
    )
    items = F.array_sort(F.array_distinct(F.coalesce(F.flatten("_items"), F.expr("array()"))))
    return rows.select(id_col, "n_words", merged.alias("spans"), items.alias("items"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows whose text holds no benchmark window, with all their columns."""
    at = docs.columns.index(text_col)

    def clean(rows: DataFrame, index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not scan(words_of(t.as_py()), index.value)[0] for t in batch.column(at)], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    with Scratch(docs.sparkSession) as scratch:
        for index, only in _indexes(docs, benchmark, scratch, text_col, **options):
            if only:
                return clean(docs, index)
            before, docs = docs, scratch.keep(clean(docs, index))
            index.destroy()
            if id(before) in scratch.paths:
                scratch.drop(before)
        return settle(docs) if id(docs) in scratch.paths else docs
