import random

import numpy as np
import pytest

from netquarry.llm import repeats

SCHEMA = "doc_id long, text string, spans string, _id string"


def _brute(texts, length):
    """Covered bytes of each text by strings that start at two places."""
    places = {}
    data = [(t or "").encode() for t in texts]
    for k, b in enumerate(data):
        for i in range(len(b) - length + 1):
            places.setdefault(b[i : i + length], []).append((k, i))
    out = [np.zeros(len(b), dtype=bool) for b in data]
    for found in places.values():
        if len(found) > 1:
            for k, i in found:
                out[k][i : i + length] = True
    return data, out


def _texts(r):
    text = lambda n: "".join(r.choice("abc é") for _ in range(n))
    passages = [text(n) for n in (30, 39, 40, 41, 60, 200)]
    out = [None, "", "short", "ab" * 200, "x" * 90, text(3000)]
    for _ in range(40):
        out.append(text(r.randint(0, 80)) + r.choice(passages) + text(r.randint(0, 80)) + r.choice(passages)[: r.randint(20, 200)] + text(5))
    out += [out[10], out[10], out[11] + "!"]
    near = list(out[12] + out[13])
    for _ in range(12):
        near[r.randrange(len(near))] = "z"
        out.append("".join(near))
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 20_000), (2, 20_000), (3, 1)])
def test_spans_equal_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "PART", 700)
    monkeypatch.setattr(repeats, "BUFFER", 3000)
    texts = _texts(random.Random(seed))
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in enumerate(texts)], SCHEMA)
    got = {g.doc_id: g for g in repeats.remove_repeats(df, length=40, gram=12).collect()}
    for k, (b, covered) in enumerate(zip(*_brute(texts, 40), strict=True)):
        mine = np.zeros(len(b), dtype=bool)
        for s in got[k].spans:
            mine[s.begin : s.end] = True
        assert (mine == covered).all(), k
        assert bytes(got[k].kept) == np.frombuffer(b, dtype=np.uint8)[~covered].tobytes() and got[k].n_bytes == len(b)
        edges = [s.begin for s in got[k].spans][1:], [s.end for s in got[k].spans][:-1]
        assert all(a > b for a, b in zip(*edges, strict=True))  # maximal runs


def test_repeated_and_null_identifiers(spark):
    t = "".join(random.Random(5).choice("abcdef") for _ in range(900))
    df = spark.createDataFrame([(1, t, "c", "c"), (1, t, "c", "c"), (None, "x" + t[:500], "c", "c"), (None, None, "c", "c")], SCHEMA)
    got = repeats.remove_repeats(df).collect()
    assert sorted((g.doc_id is None, g.n_bytes, len(g.kept)) for g in got) == [(False, 900, 0), (False, 900, 0), (True, 0, 0), (True, 501, 1)]


def test_equal_names_of_different_bytes_are_no_repeats(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(repeats, "_name", lambda hashes, data, at, *_: np.zeros(len(at), dtype=np.uint64))
    rows = {"gram": [1, 1, 1], "want": [True] * 3, "_id": [1, 2, 3], "_text": [0] * 3, "first": [0] * 3, "ahead": [0] * 3}
    rows["context"] = [b"abcdefgh", b"xbcdefgy", b"zzzz1111"]
    table = pa.table({k: pa.array(v, pa.binary()) if k == "context" else v for k, v in rows.items()})
    got = repeats._repeated(table, 4).to_pylist()
    assert sorted((g["_id"], g["begin"], g["end"]) for g in got) == [(1, 1, 7), (2, 1, 7)]


@pytest.mark.parametrize("kind", ["string", "decimal(20,0)", "date"])
def test_identifiers_of_other_types(spark, kind):
    t = "".join(random.Random(5).choice("abcdef") for _ in range(900))
    df = spark.createDataFrame([(t,), (t + "x",), ("short",)], "text string")
    ids = {"string": "concat('d', length(text))", "date": "date_add(date'2020-01-01', length(text))"}.get(kind, f"cast(length(text) as {kind})")
    df = df.selectExpr(f"{ids} as doc_id", "text")
    got = repeats.remove_repeats(df)
    assert got.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    assert sorted((g.n_bytes, len(g.kept)) for g in got.collect()) == [(5, 5), (900, 0), (901, 1)]


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("hot", [1, 8])
def test_many_contexts_of_a_gram_are_not_taken_apart_to_strings(spark, monkeypatch, hot):
    """Near copies have very many contexts round one gram; each of their strings was a row."""
    r = random.Random(3)
    text = "".join(r.choice("abcdefgh ") for _ in range(500))
    texts = []
    for _ in range(60):
        k = r.randrange(len(text))
        texts.append(text[:k] + "".join(r.choice("xyz") for _ in range(4)) + text[k + 4 :])
    kept, keep = [], repeats.Scratch.keep

    def counted(self, df):
        out = keep(self, df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(repeats.Scratch, "keep", counted)
    monkeypatch.setattr(repeats, "HOT", hot)
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in enumerate(texts)], SCHEMA)
    got = {g.doc_id: g for g in repeats.remove_repeats(df, length=200, gram=48).collect()}
    data, covered = _brute(texts, 200)
    for k, b in enumerate(data):
        assert bytes(got[k].kept) == np.frombuffer(b, dtype=np.uint8)[~covered[k]].tobytes()
    assert any(c.any() and not c.all() for c in covered)
    strings = sum(len(b) - 200 + 1 for b in data)
    assert max(kept) < strings / 10


def test_planted_passages_are_removed_from_400_bytes_on(spark):
    """A passage of over 50 words in two documents goes where it has 400 bytes, at any place; others and clean texts stay whole."""
    r = random.Random(11)
    words = lambda n, k: " ".join("".join(r.choice("abcdefghij") for _ in range(k)) for _ in range(n))
    short, long = [words(52, 6) for _ in range(20)], [words(57, 7) for _ in range(20)]  # 363 and 455 bytes
    made = [(f"{words(r.randint(0, 60), 5)}|{p}|{words(r.randint(0, 60), 5)}", p) for p in short + long for _ in range(2)]
    made += [(words(r.randint(0, 200), 5), "") for _ in range(40)]
    df = spark.createDataFrame([(i, t, "c", "c") for i, (t, _) in enumerate(made)], SCHEMA)
    for g in repeats.remove_repeats(df).collect():
        text, passage = made[g.doc_id]
        kept = bytes(g.kept).decode()
        assert g.n_bytes == len(text)
        if passage in long:  # the marks beside it are equal in both documents, and so are bytes beyond them by chance
            assert passage not in kept and 0 <= len(text) - len(kept) - len(passage) <= 12
        else:
            assert kept == text
