"""The inverted file against brute force, and BM25 with identifiers of any type."""

import math
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from netquarry.operators import retrieval
from netquarry.operators import vector_index as vi

SF_DIR = "/root/testdata/sf0.01"


def _rows(n=600, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(7, dim))
    return [(int(i), (middle[i % 7] * (i % 3) + rng.normal(size=dim)).tolist()) for i in range(n)]


def _brute(rows, asked, k):
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    out = {}
    for q in asked:
        scores = sorted((-round(float(x[q] @ v), 6), i) for i, v in x.items() if i != q)
        out[q] = [i for _, i in scores[:k]]
    return out


def _found(df):
    out = defaultdict(list)
    for r in df.orderBy("q", "rank").collect():
        out[r.q].append(r.c)
    return dict(out)


@pytest.mark.parametrize("most", [vi.MOST_BROADCAST, 0])
def test_an_exact_search_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(vi, "MOST_BROADCAST", most)
    monkeypatch.setattr(vi, "BLOCK", 16)
    monkeypatch.setattr(vi, "QUERY_BLOCK", 8)
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = vi.VectorIndex(df, "id", "v", cells=12, sample=200)
    asked = [i for i, _ in rows if i % 20 == 0]
    got = index.search(df.where("id % 20 = 0"), "id", "v", 5, recall=0.1, exact=True)
    assert _found(got) == _brute(rows, asked, 5)


def test_left_out_vectors_ties_and_names(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.5, 0.0]), ("d", [0.0, 0.0]), ("e", []), ("f", None), ("g", [1.0, 0.0, 0.0]), ("h", [-1.0, 0.1]), (None, [3.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, v array<double>, cell string")
    index = vi.VectorIndex(df, "id", "v", cells=2)
    got = index.search(df, "id", "v", 10, exact=True)
    found = _found(got)
    assert found["a"] == ["b", "c", None, "h"] and found["h"] == ["a", "b", "c", None] and found[None] == ["a", "b", "c", "h"]
    assert set(found) == {"a", "b", "c", "h", None}
    empty = vi.VectorIndex(df.limit(0), "id", "v")
    assert empty.search(df, "id", "v", 3).count() == 0


def test_recall_of_the_default_search(spark):
    if not Path(SF_DIR).exists():
        pytest.skip("no test tables here")
    e = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in e.collect()]
    asked = [i for i, _ in rows if i % 5 == 0]
    index = vi.VectorIndex(e, "vec_id", "embedding")
    got, want = _found(index.search(e.where("vec_id % 5 = 0"), "vec_id", "embedding", 10)), _brute(rows, asked, 10)
    assert sum(len(set(got.get(q, [])) & set(want[q])) for q in asked) >= 0.9 * 10 * len(asked)


def _okapi(docs, queries, k, itself=True):
    """Plain Okapi over (id, tokens)."""
    n, mean = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = Counter(t for _, ts in docs for t in set(ts))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    out = {}
    for q, words in queries:
        scores = []
        for d, ts in docs:
            tf = Counter(ts)
            if set(tf) & set(words) and (itself or d != q):
                s = sum((idf[t] if idf[t] >= 0 else floor) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for t in words if t in tf)
                scores.append((-round(s, 5), d is None, d))
        out[q] = [(d, -s) for s, _, d in sorted(scores, key=lambda x: (x[0], x[1], x[2] or ""))[:k]]
    return out


@pytest.mark.parametrize("most", [retrieval.MOST_TERMS, 0])
@pytest.mark.parametrize("itself", [True, False])
def test_bm25_with_names_and_nulls_on_both_paths(spark, monkeypatch, most, itself):
    monkeypatch.setattr(retrieval, "MOST_TERMS", most)
    words = "ab cd ef gh ij kl mn".split()
    docs = [(f"d{i:02d}", [words[(i * j) % 7] for j in range(1, 3 + i % 5)]) for i in range(30)] + [("none", []), (None, ["ab", "ab"])]
    queries = [("d03", ["ab", "ef", "ab"]), ("q", ["mn", "zz"]), (None, ["gh"])]
    rows = retrieval.bm25(
        spark.createDataFrame(docs, "id string, ts array<string>"), spark.createDataFrame(queries, "id string, ts array<string>"),
        "id", "id", "ts", 6, itself=itself,
    )
    got = defaultdict(list)
    for r in rows.orderBy("rank").collect():
        got[r.q].append((r.d, round(r.score, 5)))
    want = {q: x for q, x in _okapi(docs, queries, 6, itself).items() if x}
    assert {q: [d for d, _ in x] for q, x in got.items()} == {q: [d for d, _ in x] for q, x in want.items()}
    assert all(abs(s - t) < 2e-5 for q in want for (_, s), (_, t) in zip(got[q], want[q], strict=True))
