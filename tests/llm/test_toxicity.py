import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from netquarry.llm import toxicity as tx

DOCS = "doc_id long, text string, score string"


def _corpus(n=700, seed=3):
    """Label 1: an insult, or one of two harmless words together with the other."""
    r = random.Random(seed)
    words = ["".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 6))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 120))]
        kind = r.randrange(6)
        add = {0: ["Idiot"], 1: ["those", "people"], 2: ["those"], 3: ["people"]}.get(kind, [])
        for a in add:
            w.insert(r.randrange(len(w)), a)
        docs.append((i, " ".join(w), "c"))
        labels.append((i, int(kind in (0, 1))))
    return docs, labels


def test_held_out_accuracy_with_an_interaction(spark):
    docs, labels = _corpus()
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.train(d, l.where(~tx.held_out(F.col("doc_id"))))
    got = {r.doc_id: r.score for r in tx.score(d, model).collect()}
    held = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((s >= 0.5) == bool(y) for s, y in held)
    assert right / len(held) > 0.93
    clean = tx.keep_below(d, model, 0.7)
    assert clean.schema == d.schema and {r.doc_id for r in clean.collect()} == {i for i, s in got.items() if s < 0.7}


def test_score_is_the_factorization_machine():
    r = np.random.default_rng(1)
    m = tx.Model(0.3, {}, r.normal(size=6), r.normal(size=(6, tx.RANK)))
    rows = [[], [2], [0, 3, 5]]
    for row, s in zip(rows, m.scores(rows), strict=True):
        raw = 0.3 + sum(m.linear[i] for i in row) + sum(m.pairs[i] @ m.pairs[j] for i in row for j in row if i < j)
        assert abs(s - 1 / (1 + np.exp(-raw))) < 1e-9


def test_odd_rows(spark):
    docs, labels = _corpus(200)
    odd = [(900, None, "c"), (901, "", "c"), (902, "idiot " * 100_000, "c"), (None, "idiot", "c"), (3, docs[3][1], "c")]
    d = spark.createDataFrame(docs + odd, DOCS)
    l = spark.createDataFrame([*labels, (5, None), (None, 1), (3, labels[3][1])], "doc_id long, toxic int")
    rows = tx.score(d, tx.train(d, l)).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[900] == by[901] and by[902] > 0.7


def test_no_labels_and_empty_tables(spark):
    docs, labels = _corpus(20)
    d, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r.score, 9) for r in tx.score(d, tx.train(d, none)).collect()} == {0.5}
    one_kind = spark.createDataFrame([(i, 0) for i, _ in labels], "doc_id long, toxic int")
    assert {round(r.score, 9) for r in tx.score(d, tx.train(d, one_kind)).collect()} == {round(1 / 22, 9)}
    empty = spark.createDataFrame([], DOCS)
    assert tx.score(empty, tx.train(empty, none)).count() == 0
