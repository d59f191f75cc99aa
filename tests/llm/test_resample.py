"""Resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest

from netquarry.llm import resample as rs
from netquarry.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    runs = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def _plain(docs, target, percent=5):
    made = [(i, *_features(t)) for i, t in docs]
    s, t = Counter(b for m in made for b in m[2]), Counter(b for x in target for b in _features(x)[1])
    alls, allt = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * alls / ((s[b] + 1) * allt)))
    rows = []
    for i, n, buckets in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, buckets))
        rows.append((i, n, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    return rows, fit[: percent * len(fit) // 100]


def _check(got, docs, target, percent=5):
    rows, drawn = _plain(docs, target, percent)
    assert Counter((g.doc_id, g.n_features, g.weight, g.score) for g in got) == Counter((r[0], *r[2:]) for r in rows)
    ranked = sorted((g for g in got if g.rank is not None), key=lambda g: g.rank)
    assert [g.rank for g in ranked] == list(range(1, len(drawn) + 1))
    assert [(g.doc_id, g.score) for g in ranked] == [(r[0], r[4]) for r in drawn]


def test_registered_query(spark):
    if not Path(SF_DIR).exists():
        pytest.skip("no test tables here")
    table = lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")
    docs = [(r.doc_id, r.text) for r in table("documents").collect()]
    df = QUERIES["op13_importance_resampling"](spark, SF_DIR)
    assert all(kind == "bigint" for _, kind in df.dtypes)
    _check(df.collect(), docs, [r.text for r in table("benchmark").collect()])


def test_nulls_ties_long_texts_and_clashing_names(spark):
    text = "Ünder Σ words Of many KINDS 12 and-signs İ straße " * 3
    docs = [(None, text), (1, None), (2, ""), (3, "!? ."), (4, text), (4, text), (5, text), (6, "long words " * 30_000), (7, "K only nineteen " * 6)]
    docs += [(8, f"{k} {text}") for k in range(40)] + [(9, text)] * 40
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, _buckets string, rank int")
    target = spark.createDataFrame([("many words of kinds",), (None,)], "text string")
    _check(rs.resample(rows, target, percent=30).collect(), docs, ["many words of kinds", None], 30)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b c " * 20)], "doc_id long, text string")
    assert rs.resample(none, one).count() == 0
    _check(rs.resample(one, none, percent=100).collect(), [(1, "a b c " * 20)], [], 100)


def test_gains_are_one_literal(spark):
    plan = spark.range(1).select(rs._literal([1, -2, 3]).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "[1,-2,3]" in plan
