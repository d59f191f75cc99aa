import random
import re

import pytest

from netquarry.llm import decontaminate as dc

DOCS, ITEMS = "doc_id long, text string, items string", "item_id long, text string, window string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def _brute(docs, items, size):
    wins = {}
    for i, t in items:
        w = _words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w, hit, ids = _words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if found := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= found
        out[i] = (len(w), len(hit), sorted(ids))
    return out


def _tables(spark):
    r = random.Random(4)
    vocabulary = ["the", "of", "É", "x1", "Foo", "bar", "rare", "zz"]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 3, 12, 15]))) for i in range(25)] + [(90, None), (91, " ... "), (92, "lone"), (0, "again the item")]
    docs = []
    for i in range(120):
        body = text(r.randint(0, 60))
        if i % 3 == 0:
            body += " " + (r.choice(items)[1] or "") + " " + text(3)
        docs.append((i, body))
    docs += [(500, None), (501, ""), (502, "!!"), (503, "LONE"), (504, "the " * 50000)]
    return docs, items, spark.createDataFrame([(*d, "c") for d in docs], DOCS), spark.createDataFrame([(*i, "c") for i in items], ITEMS)


@pytest.mark.parametrize("block", [7, 200_000])
def test_hits_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK", block)
    docs, items, d, b = _tables(spark)
    want = _brute(docs, items, 10)
    got = dc.hits(d, b).collect()
    assert len(got) == len(docs)
    for g in got:
        assert (g.n_words, sum(s.end - s.begin for s in g.spans), list(g["items"])) == want[g.doc_id], g.doc_id
    clean = dc.keep_clean(d, b)
    assert clean.schema == d.schema
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, x in want.items() if not x[1])


def test_empty_tables(spark):
    docs, _, d, b = _tables(spark)
    assert dc.hits(spark.createDataFrame([], DOCS), b).count() == 0
    none = dc.hits(d, spark.createDataFrame([], ITEMS)).collect()
    assert len(none) == len(docs) and not any(g.spans for g in none)
