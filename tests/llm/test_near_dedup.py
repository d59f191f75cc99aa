import random

import numpy as np
import pytest

from netquarry.llm import near_dedup as nd
from netquarry.llm.common import words_of

SCHEMA = "doc_id long, text string, extra string"


def _text(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def _edited(r, text, n):
    words = text.split()
    for _ in range(n):
        at = r.randrange(len(words))
        words[at : at + r.choice([0, 1, 1])] = [_text(r, 1)]
    return " ".join(words)


def _brute(rows):
    cache = nd._Words()
    by = {i: words_of(t) for i, t in rows if i is not None}
    h = {i: nd.shingles(w, cache) for i, w in by.items() if w}
    root = {i: i for i in by}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(h)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if find(a) != find(b) and (by[a] == by[b] or nd.similar(h[a], h[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in by}


def test_aligned_is_the_longest_common_subsequence():
    r = random.Random(5)
    for _ in range(200):
        a = np.array(r.sample(range(60), r.randint(1, 40)), dtype=np.uint64)
        b = np.array(r.sample(range(60), r.randint(1, 40)), dtype=np.uint64)
        best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        assert nd.aligned(a, b, 100) == best[-1, -1]


def test_repeated_shingles_are_labelled():
    h = nd.shingles(b"a b c d e a b c d e a b c d e".split(), nd._Words())
    assert len(set(h.tolist())) == len(h) == 11


@pytest.mark.parametrize("split", [0, 16])
def test_classes_equal_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(nd, "SPLIT", split)
    r = random.Random(1)
    base = _text(r, 150)
    rows = [(i, _edited(r, base, r.randint(1, 12))) for i in range(100, 220)]
    rows += [(i, _text(r, r.randint(1, 80))) for i in range(300, 340)]
    rows += [(i, rows[k][1].upper() + " .") for i, k in ((1, 3), (2, 3), (400, 130), (401, 131))]
    rows += [(500, None), (501, ""), (502, " ... "), (503, None), (504, "one"), (505, "One!"), (None, base), (None, base)]
    rows += [(600, "word " * 30000), (601, "word " * 29000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = nd.near_classes(df).collect()
    assert len(got) == len(rows)
    assert {g.doc_id: g.class_id for g in got if g.doc_id is not None} == _brute(rows)
    for g in got:
        assert g.kept == (g.doc_id == g.class_id)
    stays = nd.keep_one(df)
    assert stays.columns == df.columns
    assert stays.count() == sum(g.kept for g in got if g.doc_id is not None) + 2


def test_empty_table(spark):
    assert nd.near_classes(spark.createDataFrame([], SCHEMA)).count() == 0
