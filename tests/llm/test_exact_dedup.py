import hashlib
import random
import re

import pytest

from netquarry.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, _norm string, _bucket int"


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def _rows():
    r = random.Random(2)
    texts = [None, "", " ", "a b", "a\t\n b", "a b", "é\u00a0x", "long " * 40000, "long\n" * 40000]
    texts += ["hot copy of one text"] * 400 + ["".join(r.choice("ab \n") for _ in range(6)) for _ in range(200)]
    r.shuffle(texts)
    return [(i if i % 50 else None, t, "x", 1) for i, t in enumerate(texts)] + [(7, "same row", "x", 1)] * 3


@pytest.mark.parametrize("n", ["1", "16"])
def test_groups_equal_brute_force(spark, n):
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        rows = _rows()
        got = ed.exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(_norm(t), []).append(i)
    want = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    key = lambda x: (str(x[0]), str(x[1]), x[2], x[3])
    assert sorted(((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got), key=key) == sorted(want, key=key)
    assert sum(g.kept for g in got) == len(groups)  # one of each group, of repeated rows too
    assert all(g.doc_id == g.keep_id for g in got if g.kept)


def test_kept_rows_are_whole(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    stays = ed.keep_first(df)
    assert stays.schema == df.schema
    assert stays.count() == len({_norm(t) for _, t, *_ in _rows()})


def test_hot_group_is_spread(spark):
    cuts = ed.splitters(spark.range(4000).selectExpr("id as doc_id", "'one text' as text"), "doc_id", "text", 8)
    assert len(cuts) == 7  # all splitters lie inside of the group


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ed.exact_groups(df).count() == 0 and ed.keep_first(df).count() == 0
