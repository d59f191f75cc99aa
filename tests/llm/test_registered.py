"""The registered queries over the smallest tables, against plain Python."""

import base64
import hashlib
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import tiktoken
from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from netquarry.llm import near_dedup as nd
from netquarry.llm.common import words_of
from netquarry.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    if not Path(SF_DIR).exists():
        pytest.skip("no test tables here")
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def _rows(spark, name):
    return QUERIES[name](spark, SF_DIR).collect()


def test_op1(spark, docs):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for i, text in docs.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[(i, k // 4096, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    got = _rows(spark, "op1_best_fit_packing")
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    places = defaultdict(list)
    for g in got:
        places[g.sequence_id].append((g.offset, g.length))
    for p in places.values():
        ends = [0, *(a + n for a, n in sorted(p))]
        assert [a for a, _ in sorted(p)] == ends[:-1] and ends[-1] <= 4096
    assert len(places) <= -(-sum(g.length for g in got) // 4096) + 1


def test_op3(spark, docs):
    data, places = {i: t.encode() for i, t in docs.items()}, defaultdict(list)
    for i, b in data.items():
        for k in range(len(b) - 399):
            places[hashlib.blake2b(b[k : k + 400], digest_size=12).digest()].append((i, k))
    covered = {i: bytearray(len(b)) for i, b in data.items()}
    for found in places.values():
        for i, k in found if len(found) > 1 else ():
            covered[i][k : k + 400] = b"\1" * 400
    for g in _rows(spark, "op3_suffix_dedup"):
        b, c = data[g.doc_id], covered[g.doc_id]
        kept = bytes(x for x, gone in zip(b, c, strict=True) if not gone)
        runs = sum(x and not y for x, y in zip(c, b"\0" + c, strict=False))
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (len(b), sum(c), runs, hashlib.sha256(kept).hexdigest())


def test_op4(spark, docs):
    got, load, slots, home = _rows(spark, "op4_sharding"), Counter(), defaultdict(list), {}
    for g in got:
        data = docs[g.doc_id].encode()
        assert (g.size, g.text_crc32, g.law, g.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        assert home.setdefault(data, g.shard) == g.shard and 0 <= g.shard < 40
        load[g.shard] += g.size
        slots[g.shard].append(g.slot)
    assert len(got) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    heaviest = max(Counter({t: sum(len(x.encode()) + 16 for x in docs.values() if x == t) for t in set(docs.values())}).values())
    assert max(load.values()) <= max(heaviest, sum(load.values()) / 40 * 1.1)


def test_op6(spark, docs):
    got = _rows(spark, "op6_toxicity")
    assert sorted(g.doc_id for g in got) == sorted(docs)
    for g in got:
        assert g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1)
        assert 0 <= g.score <= 1 and g.predicted == (g.score >= 0.7)


def test_op7(spark, docs):
    cache, root = nd._Words(), {i: i for i in docs}
    h = {i: nd.shingles(words_of(t), cache) for i, t in docs.items()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in docs if len(h[i]))
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if nd.similar(h[a], h[b]) and find(a) != find(b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    sizes = Counter(find(i) for i in docs)
    got = _rows(spark, "op7_minhash_near_dedup")
    assert len(got) == len(docs)
    for g in got:
        assert (g.class_id, g.class_size, g.kept) == (find(g.doc_id), sizes[find(g.doc_id)], find(g.doc_id) == g.doc_id)


def test_op8(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = _rows(spark, "op8_html_extraction")
    assert sorted(g.page_id for g in got) == sorted(pages)
    for g in got:
        assert g.url == pages[g.page_id].url and g.n_chars == len(g.text) and g.text == " ".join(g.text.split())


def test_op9(spark, docs):
    with open(tokenizer_path("byte_bpe_50k.tiktoken")) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for g in _rows(spark, "op9_edit_aware_token_counts"):
        assert g.n_tokens_before == len(encoding.encode_ordinary(docs[g.doc_id]))
        assert g.n_edits == 6


ROWS = [
    (None, "a text without a number " * 9, None, None, None),
    (1, None, None, "x", 0), (1, None, None, "x", 0), (2, "", "en", None, 0), (3, " \n ", "en", "x", 3),
    (4, "same words in both rows " * 5, "en", "x", 1), (4, "same words in both rows " * 5, "en", "x", 1), (5, "same words in both rows " * 5, "en", "x", 1),
    (6, "long " * 40_000, "en", "x", 1), (7, "é 漢字 \U0001f600 " * 30, "zh", "x", 1),
]


@pytest.mark.parametrize("stage", [n for n, _ in cp.STAGES])
def test_a_stage_with_nulls_ties_and_none(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = spark.createDataFrame(ROWS, schema).withColumns({c: F.lit("clash") for c in ("id", "value", "_text", "key", "spans")})
    got = dict(cp.STAGES)[stage](spark, rows, SF_DIR).collect()
    ids = Counter(g.doc_id for g in got)
    if stage == "packing":
        assert set(ids) == {r[0] for r in ROWS} and sum(g.length for g in got if g.doc_id == 1) == 2
    elif stage == "exact_dedup":  # null and empty are equal, and so are the rows of 4 and 5
        assert ids == {None: 1, 1: 1, 3: 1, 4: 1, 6: 1, 7: 1}
    elif stage == "near_dedup":  # texts without words stay, and so do all rows of the identifier that stays
        assert ids == {None: 1, 1: 2, 2: 1, 3: 1, 4: 2, 6: 1, 7: 1}
    else:
        assert ids == Counter(r[0] for r in ROWS)
    if stage != "packing":
        assert all(g["key"] == "clash" for g in got)
    empty = dict(cp.STAGES)[stage](spark, spark.createDataFrame([], schema), SF_DIR)
    assert empty.count() == 0
