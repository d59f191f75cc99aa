"""Block search against plain Python: ties, null, zero and shorter vectors, many groups, slices and pieces."""

import math
import random

import pytest

from netquarry.operators import vector_search


@pytest.mark.parametrize("before", [False, True])
def test_nearest_rows(spark, monkeypatch, before):
    for name, value in {"GROUP": 5, "PIECE": 7, "SLICE": 60, "LEAST_TASKS": 4}.items():
        monkeypatch.setattr(vector_search, name, value)
    r = random.Random(2)
    held = [[float(r.randint(-2, 2)) for _ in range(3)] for _ in range(12)] + [[0.0, 0.0, 0.0], [1.0, 2.0], None, []]
    rows = {i: r.choice(held) for i in range(1, 201)}
    df = spark.createDataFrame(list(rows.items()), "id long, v array<double>")
    asked = df.where("id % 10 = 0")
    got = vector_search.nearest_rows(asked, df, "id", "v", 4, digits=6, before=before).collect()
    want = set()
    for q, a in rows.items():
        if q % 10 == 0:
            met = [c for c in rows if (c < q if before else c != q)]

            def score(c):
                b = rows[c]
                n = math.hypot(*(a or [])) * math.hypot(*(b or []))
                return round(sum(x * y for x, y in zip(a, b)) / n, 6) if a and b and len(a) == len(b) and n else 0.0

            best = sorted(met, key=lambda c: (-score(c), c))[:4]
            want |= {(q, c, score(c), k) + ((len(met),) if before else ()) for k, c in enumerate(best, 1)}
    assert {(x.q, x.c, x.score + 0.0, x["rank"]) + ((x.met,) if before else ()) for x in got} == want
