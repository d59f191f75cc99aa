"""Near-duplicate classes by Order MinHash, with candidates verified by banded alignment.

A document is its sequence of five-word shingles, each labelled with its occurrence number. A sketch is `SKETCHES`
values; each takes the `DRAWN` labelled shingles that are least under its own hash and keeps them in text order, so
equal values speak for an equal order too. Two documents are similar if an alignment of their shingle sequences shows

    aligned / (shingles of a + shingles of b - aligned) >= 0.8

where aligned shingles are equal and in the same order in both. Such an alignment leaves at most
(1 - 0.8) / (1 + 0.8) of all shingles out, so partners lie in a band of that width round the diagonal, and only the
band is aligned. At 0.8 a pair shares no value with a probability of about 5e-6.

1. Documents with equal words are collapsed to the least identifier (counted before the shuffle).
2. In each bucket of an equal value, members are paired with the bucket's leader only, a member of many common
   shingles and few rare ones; these pairs are verified and joined to components. A group of g near copies costs about g pairs, not g * g.
3. Where a bucket still has members of several components, pairs between different components are verified too
   (members outside of the bucket's largest component against all others). Pairs inside a component can't change it.
   The members of a bucket with over `SPLIT` such pairs, say copies with many edits of one text, are joined by prefix
   filter first: of their shingles, rare ones first, similar documents share one among the first fifth, at places that
   leave enough shingles to align, and their maps of shingles differ in few bits. The filter is exact whatever the order is; the order only makes it selective.

So no link between two components is lost among the candidates. Texts go to verification in blocks of a leader and
some of its partners, streamed from a sorted partition; no group is gathered as a whole.

Above `SPLIT` more pairs are candidates than below, where a pair must share a sketch value: the filter meets all similar
pairs of the documents that it gets. So a larger bucket can only add links that hold at 0.8, and the tests run both ways.

Documents of under five words are one shingle. Texts without words (null, empty, signs only) and rows without an
identifier are left alone, each a class by itself. Rows that share an identifier are one document with several texts;
each row counts in its class. Occurrence labels follow the text: where one more copy of a repeated shingle comes early,
the later copies move on by one label and align only as far as that leaves them in order.

Hot keys: exact copies are counted before the shuffle, and every join on words, values, leaders or roots has a written
table on either side, so that both are plain exchanges and adaptive execution splits the partition of a key that holds
very many rows. Tables that are no longer needed are deleted as soon as the next one is written.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import Scratch, parts, settle, small, words_of
from netquarry.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 12
DRAWN = 2
BLOCK = 256  # partners that are verified with one copy of a leader's text
SPLIT = 16  # pairs between components over which a bucket's members are joined by prefix filter
VALUES = [f"value{i}" for i in range(SKETCHES)]
MAP = 8  # longs of a map of shingles
SAMPLE_DOCS = 4096  # documents, about, that tell which shingles are common
SLOT_BITS = 22
_MOST = 300_000

_U = np.uint64
_SEEDS = np.random.default_rng(5).integers(1, 2**63, SKETCHES, dtype=np.uint64) | _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every bit of the input moves about half of the output's bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= _MOST:
                self.clear()
            self[word] = h
        return h


def shingles(words: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
    """Hashes of the labelled shingles, in text order."""
    w = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(SHINGLE, len(w))
    n = len(w) - k + 1 if k else 0
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + w[i : i + n])
    if n > 1:
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        if same.any():
            at = np.arange(n)
            starts = np.concatenate([[True], ~same])
            nth = at - np.maximum.accumulate(np.where(starts, at, 0))
            label = np.empty(n, dtype=np.uint64)
            label[order] = nth
            h = np.where(label > 0, _mix(h + label * _U(0xD6E8FEB86659FD93)), h)
    return h


def sketch(h: np.ndarray) -> np.ndarray:
    """SKETCHES values of labelled shingles h."""
    x = _mix(h[None, :] ^ _SEEDS[:, None])
    rows = np.arange(SKETCHES)
    drawn = []
    for _ in range(min(DRAWN, len(h))):
        at = x.argmin(axis=1)
        drawn.append(at)
        x[rows, at] = _U(2**64 - 1)
    value = _SEEDS.copy()
    for at in np.sort(np.stack(drawn), axis=0):
        value = _mix(value * _U(0x9E3779B97F4A7C15) + h[at])
    return value.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of labelled shingles with partners at most `band` places apart.

    Labelled shingles are distinct in a document, so it is the longest rising run of partners' places."""
    order = np.argsort(a)
    at = np.searchsorted(a[order], b)
    at[at == len(a)] = 0
    place = order[at]
    j = np.flatnonzero(a[place] == b)
    i = place[j]
    i = i[np.abs(i - j) <= band]
    if len(i) < 2 or (np.diff(i) > 0).all():
        return len(i)
    tails = np.empty(len(i), dtype=i.dtype)
    n = 0
    for x in i.tolist():
        k = int(np.searchsorted(tails[:n], x))
        tails[k] = x
        n = max(n, k + 1)
    return n


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    total = len(a) + len(b)
    need = least * total / (1 + least) - 1e-9
    if min(len(a), len(b)) < need:
        return False
    return aligned(a, b, int((1 - least) / (1 + least) * total + 1e-9)) >= need


def _common(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """How often shingles are met in about SAMPLE_DOCS documents, by SLOT_BITS of their hash.

    It tells the shingles of large groups from rare ones. It only guides: what is found doesn't depend on it."""
    share = max(1, docs.count() // SAMPLE_DOCS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, n = _Words(), np.zeros(1 << SLOT_BITS, dtype=np.int32)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(n, shingles(words_of(text.as_py()), cache) >> _U(64 - SLOT_BITS), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at].astype(np.int64))], ["slot", "n"])

    some = docs.where(F.pmod(F.xxhash64(F.lit(1), F.col(id_col)), F.lit(share)) == 0).select(text_col)
    rows = some.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 2").toPandas()
    out = np.zeros(1 << SLOT_BITS, dtype=np.int32)
    out[rows["slot"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int32)
    return out


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in small(batches):
            data = pa.array([squeeze.compress((t.as_py() or "").encode("utf-8")) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data], ["id", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, text binary")


def _unpacked(text: bytes) -> list[bytes]:
    return words_of(zstandard.ZstdDecompressor().decompress(text).decode("utf-8"))


def _sketched(docs: DataFrame, id_col: str, text_col: str, common) -> DataFrame:
    """(id, key of the words, order, sketch values); key is null for a text without words.

    order is high for a document of many common shingles and few rare ones: of copies, one with few edits. Its lower
    bits come from the words, so that few documents are of the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in small(batches):
            keys, found, orders = [], np.zeros((batch.num_rows, SKETCHES), dtype=np.int64), []
            for k, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                h = shingles(words, cache)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                if words:
                    found[k] = sketch(h)
                many = int(np.count_nonzero(common.value[h >> _U(64 - SLOT_BITS)]))
                lead = max(-(1 << 22), min(1 << 22, 2 * many - len(h))) if many else 0
                orders.append((lead << 40) + (int.from_bytes(keys[-1][:5]) if words else 0))
            columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array(orders, pa.int64()), *map(pa.array, found.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "order", *VALUES])

    kind, values = docs.schema[id_col].dataType.simpleString(), ", ".join(f"{v} long" for v in VALUES)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, key binary, order long, {values}")


def _verified(pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The written pairs (a, b) whose texts are similar. docs: (id, text)."""
    sizes = scratch.keep(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")))
    dealt = pairs.join(sizes, "a")
    members = dealt.select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), "blocks").alias("block"), F.lit(1).alias("kind"))
    heads = sizes.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"))
    wanted = members.unionByName(heads)
    rows = wanted.join(docs, "id").select("a", "block", "kind", "id", "text")
    rows = rows.repartition(parts(docs.sparkSession), "a", "block").sortWithinPartitions("a", "block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, head, texts = _Words(), None, []
        for batch in batches:
            a, b = [], []
            for x, block, kind, y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingles(_unpacked(text), cache)
                if kind == 0:
                    texts = [*texts, own] if head == (x, block) else [own]
                    head = (x, block)
                elif head == (x, block) and any(similar(h, own) for h in texts):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.field(0).type), pa.array(b, batch.schema.field(0).type)], ["a", "b"])

    kind = docs.schema["id"].dataType.simpleString()
    out = scratch.keep(rows.mapInArrow(run, f"a {kind}, b {kind}"))
    scratch.drop(sizes)
    return out


def _between(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (value, id, root, ...), written, of buckets with several roots, with the commonest root and the number of
    pairs between roots."""
    each = members.groupBy("value", "root").agg(F.count(F.lit(1)).alias("n"))
    most = each.groupBy("value").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"),
        F.sum(F.col("n") * F.col("n")).alias("inside"), F.count(F.lit(1)).alias("roots"),
    ).where("roots > 1")
    most = scratch.keep(most.select("value", "main", ((F.col("all") ** 2 - F.col("inside")) / 2).alias("cross")))
    out = scratch.keep(members.join(most, "value"))
    scratch.drop(most)
    return out


def _cross_pairs(labelled: DataFrame, fits=lambda x, y: F.lit(True), more: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b) of a bucket with different roots that fit; more: columns that `fits` looks at."""
    x = labelled.where("root <> main").select(F.col("value").alias("vx"), F.struct("id", "root", *more).alias("x"))
    y = labelled.select(F.col("value").alias("vy"), F.struct("id", "root", *more).alias("y"))
    met = x.join(y, (F.col("vx") == F.col("vy")) & (F.col("x.root") != F.col("y.root")) & fits(F.col("x"), F.col("y")))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def _may_align(x: Column, y: Column) -> Column:
    """At least `need` shingles must align, and no more can than follow the shared one in either prefix. Where the
    shingle before is shared too, the pair has been met there already. Each shingle flips one bit of its document's
    map, so maps differ in no more bits than the documents do in shingles."""
    need = (x["n"] + y["n"]) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6
    fresh = x["prev"].isNull() | y["prev"].isNull() | (x["prev"] != y["prev"])
    apart = reduce(operator.add, [F.bit_count(x["bits"][k].bitwiseXOR(y["bits"][k])) for k in range(MAP)])
    return fresh & (F.least(x["n"] - x["at"], y["n"] - y["at"]) >= need) & (apart <= x["n"] + y["n"] - 2 * need)


def _prefixes(docs: DataFrame, common) -> DataFrame:
    """Of documents (id, root, text): (value, id, root, n, at, prev), the rarest shingles, as many as a similar one must
    meet, with the one before each; and a row (id, bits) with the map of all shingles for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in small(batches, 256):
            if not batch.num_rows:
                continue
            out: list[list[np.ndarray]] = [[], [], []]
            rows, maps = [], []
            for k, text in enumerate(batch.column(2)):
                h = shingles(_unpacked(text.as_py()), cache)
                odd = np.bincount((_mix(h) % _U(64 * MAP)).astype(np.int64), minlength=64 * MAP) & 1
                maps.append(np.packbits(odd.astype(np.uint8)).view(np.int64).tolist())
                first = np.lexsort((h, common.value[h >> _U(64 - SLOT_BITS)]))[: len(h) - int(np.ceil(SIMILARITY * len(h) - 1e-9)) + 1]
                rows.append(np.full(len(first), k))
                for column, x in zip(out, (h[first].view(np.int64), np.full(len(first), len(h)), np.arange(len(first))), strict=True):
                    column.append(x)
            at = pa.array(np.concatenate(rows))
            value, n, place = (np.concatenate(c) for c in out)
            prev = pa.array(np.concatenate([value[:1], value[:-1]]), mask=place == 0)
            columns = [pa.array(value), batch.column(0).take(at), batch.column(1).take(at), pa.array(n), pa.array(place), prev]
            none = pa.nulls(len(maps), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(at), pa.list_(pa.int64()))], names)
            yield pa.RecordBatch.from_arrays([none, batch.column(0), batch.column(1), none, none, none, pa.array(maps, pa.list_(pa.int64()))], names)

    names = ["value", "id", "root", "n", "at", "prev", "bits"]
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"value long, id {kind}, root {kind}, n long, at long, prev long, bits array<long>"
    return docs.select("id", "root", "text").mapInArrow(run, schema)


def _unlinked(roots: DataFrame, shared: DataFrame, stars: DataFrame, texts: DataFrame, common, scratch: Scratch) -> DataFrame | None:
    """Pairs of similar documents between components, from buckets with members of several; None if there is no such bucket."""
    rooted = shared.select("value", F.col("node").alias("id")).join(roots, F.col("id") == F.col("node"), "left")
    rooted = scratch.keep(rooted.select("value", "id", F.coalesce("root", "id").alias("root")))
    several = rooted.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    several = scratch.keep(several.select("value"))
    if several.isEmpty():
        scratch.drop(rooted, several)
        return None
    mixed = scratch.keep(rooted.join(several, "value"))
    scratch.drop(rooted, several)
    labelled = _between(mixed, scratch)
    scratch.drop(mixed)
    pairs = _cross_pairs(labelled.where(F.col("cross") <= SPLIT))
    many = labelled.where(F.col("cross") > SPLIT).select("id", "root").distinct()
    rare = None
    if not many.isEmpty():
        # A shuffle even for few rows: without it a task packs texts and unpacks them in two Python workers at once.
        places = scratch.keep(_prefixes(many.hint("merge").join(texts, "id"), common))
        met = _between(places.where("value is not null").drop("bits"), scratch)
        rare = scratch.keep(met.join(places.where("value is null").groupBy("id").agg(F.first("bits").alias("bits")), "id"))
        scratch.drop(places, met)
        pairs = pairs.unionByName(_cross_pairs(rare, _may_align, ("n", "at", "prev", "bits")))
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = scratch.keep(pairs.distinct().join(tried, ["a", "b"], "left_anti"))
    scratch.drop(labelled, *[t for t in (rare,) if t is not None])
    out = _verified(pairs, texts, scratch)
    scratch.drop(pairs)
    return out


def _classes(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, key) of each row, settled, and (key, node, n, root) of each sequence of words, written: node is the least
    identifier that has it, n the number of rows, root the least identifier of the class."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, id_col, text_col))
    made = scratch.keep(_sketched(docs, id_col, text_col, common))
    rows = settle(made.select("id", "key"))
    # One document for each sequence of words, found before any pairing. Equal words have equal sketches.
    known = made.where("key is not null and id is not null").groupBy("key")
    owners = scratch.keep(known.agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("order", *VALUES)]))
    scratch.drop(made)
    members = owners.select("node", F.explode(F.array(*VALUES)).alias("value"), "order")
    texts = _packed(docs, id_col, text_col)

    # The leader is a copy with few edits, which meets many others in its buckets and leads most buckets of its group.
    leaders = members.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.max_by("node", "order").alias("a")).where("n > 1")
    leaders = scratch.keep(leaders.select("value", "a"))
    shared = scratch.keep(members.select("value", "node").join(leaders, "value"))
    stars = scratch.keep(shared.where("node <> a").select("a", F.col("node").alias("b")).distinct())
    links = _verified(stars, texts, scratch)
    roots = components(links, scratch)
    more = _unlinked(roots, shared, stars, texts, common, scratch)
    scratch.drop(links, leaders, shared, stars)
    if more is not None and not more.isEmpty():
        both = more.unionByName(roots.withColumnsRenamed({"node": "a", "root": "b"}))
        roots = components(both, scratch)
    whole = owners.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    return rows, scratch.keep(whole)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, class_id (the least identifier of its class), class_size (its rows), kept."""
    with Scratch(docs.sparkSession) as scratch:
        rows, whole = _classes(docs, id_col, text_col, scratch)
        sizes = scratch.keep(whole.groupBy("root").agg(F.sum("n").alias("class_size")))
        classes = settle(whole.join(sizes, "root").select("key", F.col("root").alias("class_id"), "class_size"))
    known = F.col("id").isNotNull()
    out = rows.select("id", F.when(known, F.col("key")).alias("key")).join(classes, "key", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.col("id").eqNullSafe(F.coalesce("class_id", "id")).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the document that stays from each class, with all their columns."""
    with Scratch(docs.sparkSession) as scratch:
        rows, whole = _classes(docs, id_col, text_col, scratch)
        # Few words have a class of several documents or several rows.
        several = scratch.keep(whole.where("n > 1 or node <> root").select("key", "root"))
        gone = settle(rows.join(several, "key").where("id <> root").select("id").distinct())
    # Columns of docs may have any names, so they are out of the way while the names of `gone` count.
    whole = docs.select(F.col(f"`{id_col}`").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.join(gone, "id", "left_anti").select("row.*")
