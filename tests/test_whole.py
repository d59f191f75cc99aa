"""The whole job of queries whose first form reads a part of the texts, vectors or rows only, against plain Python."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import netquarry.plans  # noqa: F401
from netquarry.plans import registry


def _write(folder, **tables):
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture
def vectors(tmp_path):
    r = random.Random(3)
    ids = [*range(0, 160), *range(1000, 1120)]
    rows = {i: [r.gauss(0, 1) for _ in range(64)] for i in ids}
    table = {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(rows.values()), pa.list_(pa.float32())), "label": pa.array([i % 10 for i in ids], pa.int32())}
    folder = _write(tmp_path, embeddings=table)
    return folder, dict(zip(ids, table["embedding"].to_pylist(), strict=True))


def _dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def _cosine(a, b):
    return _dot(a, b) / (_dot(a, a) * _dot(b, b)) ** 0.5


def test_incremental_search_reads_all_rows_and_dimensions(spark, vectors):
    folder, v = vectors
    got = {r.q: (r.best, r.seen) for r in registry.QUERIES["incremental_search"](spark, folder).collect()}
    want = {}
    for q in v:
        if q % 50 == 0 and (before := [c for c in v if c < q]):
            want[q] = (max(before, key=lambda c: (round(_dot(v[q], v[c]), 7), -c)), len(before))
    assert got == want


def test_two_stages_rank_by_46_dimensions(spark, vectors):
    folder, v = vectors
    got = {(r.q, r.rank): r.c for r in registry.QUERIES["two_stage_match"](spark, folder).collect()}
    want = {}
    for q in (q for q in v if q % 50 == 0):
        coarse = sorted((c for c in v if c != q), key=lambda c: (-round(_cosine(v[q][:46], v[c][:46]), 6), c))[:100]
        fine = sorted(coarse, key=lambda c: (-round(_cosine(v[q], v[c]), 6), c))[:3]
        want |= {(q, k): c for k, c in enumerate(fine, 1)}
    assert got == want


def test_fused_vectors_have_all_dimensions(spark, vectors):
    folder, v = vectors
    got = {(r.vec_id, r.pos): r.x for r in registry.QUERIES["fused_vectors"](spark, folder).collect()}
    for i in v:
        f = [x * (0.6 if k < 46 else 0.4) ** 0.5 for k, x in enumerate(v[i])]
        assert [got[i, k] for k in range(64)] == pytest.approx([x / _dot(f, f) ** 0.5 for x in f], abs=2e-6)
    assert len(got) == 64 * len(v)


def _bm25(docs, items):
    words = {d: re.findall("[a-z0-9]+", t.lower()) for d, t in docs.items()}
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    low, mean = 0.25 * sum(idf.values()) / len(idf), sum(map(len, words.values())) / len(docs)
    idf = {w: low if x < 0 else x for w, x in idf.items()}
    out = {}
    for q, text in items.items():
        asked, scores = re.findall("[a-z0-9]+", text.lower()), {}
        for d, ws in words.items():
            tf = Counter(ws)
            if met := [w for w in asked if w in tf]:
                scores[d] = round(sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in met), 5)
        out[q] = sorted(scores, key=lambda d: (-scores[d], d))
    return out


@pytest.fixture
def corpus(tmp_path):
    """Documents of several languages and of none, far apart in number."""
    r = random.Random(5)
    vocabulary = ["rot", "blau", "red", "blue", "über", "café", "x1", "net", "flow", "port", "scan", "key"]
    docs = {d: (" ".join(r.choices(vocabulary, k=r.randint(3, 30))), lang) for d, lang in zip(range(7, 130 * 9000, 9000), ["en", "de", None, "en", "fr"] * 26, strict=True)}
    items = {q: " ".join(r.choices(vocabulary, k=4)) for q in (0, 1, 9, 4000, 20_000)}
    documents = {"doc_id": pa.array(docs, pa.int64()), "text": [t for t, _ in docs.values()], "lang": [x for _, x in docs.values()]}
    return _write(tmp_path, documents=documents, benchmark={"item_id": pa.array(items, pa.int64()), "text": list(items.values())}), docs, items


def test_bm25_scores_documents_of_every_language(spark, corpus):
    folder, docs, items = corpus
    got = {(r.q, r.rank): r.d for r in registry.QUERIES["bm25_topk"](spark, folder).collect()}
    ranked = _bm25({d: t for d, (t, _) in docs.items()}, items)
    assert got == {(q, k): d for q, found in ranked.items() for k, d in enumerate(found[:5], 1)}


def test_bm25_of_many_query_terms_is_the_same(spark, corpus, monkeypatch):
    from netquarry.operators import retrieval

    rows = lambda: sorted(map(tuple, registry.QUERIES["bm25_topk"](spark, corpus[0]).collect()))
    few = rows()
    monkeypatch.setattr(retrieval, "MOST_TERMS", 1)
    assert rows() == few


def test_fusion_of_words_and_vectors(spark, tmp_path):
    r = random.Random(8)
    vocabulary = ["rot", "blau", "red", "blue", "x1", "net", "flow", "port", "scan", "key"]
    docs = {d: " ".join(r.choices(vocabulary, k=r.randint(3, 30))) for d in range(0, 130 * 10, 10)}
    vectors = {d: [r.gauss(0, 1) for _ in range(64)] for d in docs if d % 70} | {150: []}  # 0, 70, ... have none, 150 an empty one
    folder = _write(
        tmp_path,
        documents={"doc_id": pa.array(docs, pa.int64()), "text": list(docs.values())},
        embeddings={"vec_id": pa.array(vectors, pa.int64()), "embedding": pa.array(list(vectors.values()), pa.list_(pa.float64()))},
    )
    kb = {d: t for d, t in docs.items() if vectors.get(d)}
    got = {(r.q, r.rank): r.d for r in registry.QUERIES["rank_fusion"](spark, folder).collect()}
    want, words = {}, _bm25(kb, {q: t for q, t in kb.items() if q % 50 == 0})
    for q, found in words.items():
        near = sorted((d for d in kb if d != q), key=lambda d: (-round(_cosine(vectors[q], vectors[d]), 6), d))[:100]
        score = Counter()
        for ranks in ([d for d in found if d != q][:100], near):
            for k, d in enumerate(ranks, 1):
                score[d] += 1 / (60 + k)
        want |= {(q, k): d for k, d in enumerate(sorted(score, key=lambda d: (-round(score[d], 8), d))[:3], 1)}
    assert got == want and {q for q, _ in got} == {q for q in kb if q % 50 == 0}


def _normal(text):
    out = re.sub(r"\b(a|an|the)\b", " ", re.sub(r"[!-/:-@\[-`{-~]", "", text.lower()))
    return " ".join(out.split())


def _f1(p, g):
    a, b = Counter(p.split()), Counter(g.split())
    n = (a & b).total()
    return 2 * n / (a.total() + b.total()) if n else 0.0


def test_answers_are_whole_and_golds_are_all(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(60))
    docs = {0: long + " end", 1: "El año, “a” través del mar", 2: "nothing alike", 3: None}
    golds = {0: "start of it", 40: long + " End.", 1: "año través del mar", 41: "the año", 2: "yes", 43: "x"}
    folder = _write(
        tmp_path,
        documents={"doc_id": pa.array(docs, pa.int64()), "text": list(docs.values()), "lang": ["en", "es", None, "de"]},
        benchmark={"item_id": pa.array(golds, pa.int64()), "text": list(golds.values())},
    )
    norm = {r.item_id: r.answer for r in registry.QUERIES["answer_norm"](spark, folder).collect()}
    assert norm == {i: _normal(t) for i, t in golds.items()}
    got = {r.doc_id: (r.f1, r.exact, r.good) for r in registry.QUERIES["token_f1"](spark, folder).collect()}
    for d, t in docs.items():
        p, gs = _normal(t or ""), [_normal(g) for i, g in golds.items() if i % 40 == d]
        f1 = max(_f1(p, g) for g in gs)
        assert got[d] == (round(f1, 6), p in gs, p in gs or f1 >= 0.3)
    assert got[0] == (1.0, True, True)
    words = {r.doc_id: (r.n, r.best, r.exact, r.golds) for r in registry.QUERIES["word_overlap"](spark, folder).collect()}
    assert words == {0: (61, 40, True, 2), 1: (4, 1, False, 2), 2: (0, 2, False, 1), 3: (0, 43, False, 1)}


def test_text_operators_take_whole_texts(spark, tmp_path):
    texts = {0: "x" * 50 + " naïve 日本 😀\tend", 1: "é" + "y" * 40, 2: "plain " * 20, 3: ""}
    steps = ["same start of all, then this", "same start of all, then this and more", "same start of all, but that", "same start of all, but that too"]
    folder = _write(
        tmp_path,
        documents={"doc_id": pa.array(texts, pa.int64()), "text": list(texts.values())},
        conversations={"conv_id": pa.array([1] * 4, pa.int64()), "turn": pa.array(range(4), pa.int32()), "text": steps},
    )
    run = lambda name: registry.QUERIES[f"{name}"](spark, folder).collect()
    assert {r.doc_id: r.decoded for r in run("hex_text")} == texts
    assert {r.doc_id: r.code for r in run("code_block")} == texts
    want = {d: ("".join(chr(b) if 32 <= b <= 126 else "." for b in t.encode()), t.encode()[0] if t else -1) for d, t in texts.items()}
    assert {r.doc_id: (r.ascii, r.first_byte) for r in run("printable_hex")} == want
    thoughts = {r.turn: (r.answer, r.thought) for r in run("think_strip")}
    assert thoughts[0] == (steps[0], steps[0]) and thoughts[2][0] == steps[2]
    assert {r.turn: r.is_prefix for r in run("prefix_check")} == {0: False, 1: True, 2: False, 3: True}
    assert {(r.seq, r.steps, r.merged) for r in run("prefix_merge")} == {(1, 2, steps[1]), (2, 2, steps[3])}


def test_rows_are_not_picked_by_number(spark, tmp_path):
    ids = list(range(1, 13))
    events = {
        "event_id": pa.array(ids, pa.int64()),
        "ts": pa.array([i * 60_000_000 for i in ids], pa.timestamp("us")),
        "user_id": pa.array([18 + i % 4 for i in ids], pa.int64()),
        "event_type": ["click" for _ in ids],
        "value": pa.array([float(i * 3) for i in ids], pa.float64()),
        "props": ["{}" for _ in ids],
    }
    lines = {"l_orderkey": [1, 1, 1, 2], "l_partkey": [7, 5, 7, 9], "l_linenumber": [1, 2, 3, 1], "l_suppkey": [50, 3, 1, 70]}
    folder = _write(tmp_path, events=events, lineitem=lines)
    run = lambda name: registry.QUERIES[f"{name}"](spark, folder)
    assert sorted(tuple(r) for r in run("tool_calls").collect()) == [(i, "click", 18 + i % 4) for i in ids]
    texts = {r.host: r.txt.count(" bytes):\n") for r in run("conversation_text").collect()}
    assert texts == dict.fromkeys(range(18, 22), 3)
    assert {tuple(r) for r in run("knowledge_pick").collect()} == {(1, 2, "7,5"), (2, 1, "9")}
    assert {tuple(r) for r in run("fragment_recovery").collect()} == {(a, b) for a in ids for b in ids if a * 3 > 10 and a != b and a % 4 == b % 4}
