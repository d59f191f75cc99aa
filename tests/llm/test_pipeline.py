"""The pipeline's stages and its result against plain Python on the smallest tables."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from netquarry.llm import near_dedup as nd
from netquarry.llm import toxicity
from netquarry.llm.common import words_of
from netquarry.llm.queries import END_ID, PACK_WIDTH, word_tokenizer_path

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small():
    if not Path(SF_DIR).exists():
        pytest.skip("no test tables here")
    return SF_DIR


def _near(rows):
    cache = nd._Words()
    h = {i: nd.shingles(words_of(t), cache) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in h if len(h[i]))
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if nd.similar(h[a], h[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


def _clean(rows, items):
    wins = set()
    for t in items:
        w = words_of(t)
        wins |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in wins}
    held = lambda w: any(tuple(w[k : k + n]) in wins for n in sizes for k in range(len(w) - n + 1))
    return {i for i, t in rows if not held(words_of(t))}


def test_stages_and_result(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]

    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    rows = [x for x in rows if scores[x[0]] < toxicity.THRESHOLD]
    seen = set()
    rows = [x for x in rows if (n := re.sub(r"[\x20\x09-\x0D]+", " ", x[1] or "")) not in seen and not seen.add(n)]
    stay = _near(rows)
    rows = [x for x in rows if x[0] in stay]
    stay = _clean(rows, items)
    rows = [x for x in rows if x[0] in stay]

    library = Tokenizer.from_file(word_tokenizer_path())
    want = Counter()
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids) + 1
        for k in range(0, n, PACK_WIDTH):
            want[(i, k // PACK_WIDTH, min(PACK_WIDTH, n - k))] += 1
    got = cp.run(spark, small).collect()
    assert Counter((g.doc_id, g.piece, g.length) for g in got) == want
    assert END_ID == 1 and [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
