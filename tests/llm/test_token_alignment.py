"""Alignment against a plain version that encodes with the tokenizers library."""

import hashlib
from collections import Counter
from pathlib import Path

import pytest
import sentencepiece
from public_tokenizers import PATTERN, path
from tokenizers import Tokenizer

from netquarry.llm import token_alignment as ta
from netquarry.llm.queries import QUERIES

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
SF_DIR = "/root/testdata/sf0.001"
HARD = [
    None, "", " ", "word", "two  spaces and\n\nlines \n end ", "</s> <s> <|endoftext|> plain", "▁ is altered", "né à 漢字 \U0001f600 é",
    "\tx y　z", "a" * 3000, "same words", "same words", "1234567890" * 40, "\x00\x01\x1f \x1c a", " leading", "'s 't don't",
]


def _plain(rows):
    """(number, text) -> the contract's numbers of each row, in a dict by number."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in keep} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in keep)}
    found, holders = {}, Counter()
    for i, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        own_a = [bytes(map(byte.__getitem__, a.id_to_token(x))) for x in ids_a]
        own_b = [bytes([int(b.id_to_piece(x)[3:-1], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        whole = b" " + (text or "").encode()
        if not text or b"".join(own_a) != whole or b"".join(own_b) != whole:
            ids_a = ids_b = own_a = own_b = []
        groups, left, right, na, nb, rest = [], [], [], 0, 0, list(zip(ids_b, own_b, strict=True))
        for x, s in zip(ids_a, own_a, strict=True):
            left.append(x)
            na += len(s)
            while rest and nb < na:
                right.append(rest[0][0])
                nb += len(rest.pop(0)[1])
            if na == nb:
                groups.append((left, right))
                left, right = [], []
        found[i] = ids_a, ids_b, groups
        holders.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    most = {}
    for (x, _), n in holders.items():
        most[x] = max(most.get(x, 0), n)
    out = {}
    for i, (ids_a, ids_b, groups) in found.items():
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[i] = (
            len(ids_a), len(ids_b), len(groups), len(links), sum(holders[p] == most[p[0]] for p in links),
            sum(holders[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if ids_a else "",
        )
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _got(rows, most=ta.BROADCAST_PAIRS):
    rows = ta.rated(rows, most).collect()
    digest = lambda r: hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else ""
    return {r.doc_id: (*(r[n] for n in NAMES), digest(r)) for r in rows}


@pytest.mark.parametrize("most", [ta.BROADCAST_PAIRS, 20, 0])
def test_hard_texts_on_either_side_of_the_broadcast(spark, most):
    rows = list(enumerate(HARD))
    docs = spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], "doc_id long, text string, pairs string, n int")
    assert _got(ta.aligned(docs, A, B, pattern=PATTERN), most) == _plain(rows)


def test_small_slices_and_early_partial_counts(spark, monkeypatch):
    monkeypatch.setattr(ta, "SLICE_BYTES", 50)
    monkeypatch.setattr(ta, "KEPT_PAIRS", 3)
    monkeypatch.setattr(ta, "_BLOCK", 2)
    monkeypatch.setattr(ta, "LARGE", 1)
    rows = list(enumerate(HARD))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert _got(ta.aligned(docs, A, B)) == _plain(rows)


def test_equal_and_null_identifiers_and_no_rows(spark):
    docs = spark.createDataFrame([("x", "one two"), ("x", "one two"), (None, "one two"), (None, None)], "doc_id string, text string")
    rows = ta.rated(ta.aligned(docs, A, B)).collect()
    assert sorted((r.doc_id or "", r.n_a, r.count_sum) for r in rows) == [("", 0, 0), ("", 2, 6), ("x", 2, 6), ("x", 2, 6)]
    assert ta.rated(ta.aligned(docs.limit(0), A, B)).count() == 0


def test_registered_query(spark):
    if not Path(SF_DIR).exists():
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = _plain([(r.doc_id, r.text) for r in docs])
    got = QUERIES["op11_tokenizer_alignment"](spark, SF_DIR)
    assert {r.doc_id: (*(r[n] for n in NAMES), r.groups_sha256) for r in got.collect()} == want
    assert all(dict(got.dtypes)[n] == "bigint" for n in ["doc_id", *NAMES])


def test_encoders_equal_their_libraries(monkeypatch):
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    a, b = ta.ByteLevel(A, PATTERN), ta.Pieces(B)
    texts = [*filter(None, HARD), " ".join(f"word{k}" for k in range(50))]
    assert [x.tolist() for x in a.encode(texts)] == [library.encode(" " + t, add_special_tokens=False).ids for t in texts]
    for most in (ta._MOST, 3):  # with few words kept, they change all the time
        monkeypatch.setattr(ta, "_MOST", most)
        for some in (texts, texts[::-1], texts[:3], texts):
            for text, ids in zip(some, b.encode(some), strict=True):
                assert (ids is None) == ("▁" in text) and (ids is None or ids.tolist() == b.library.encode(text))
