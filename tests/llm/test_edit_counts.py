import random

import public_tokenizers as P
import pytest

from netquarry.llm import edit_counts as ec

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return ec.Encoder(PATH, P.PATTERN)


def test_every_edit_equals_encoding_anew(encoder):
    r = random.Random(3)
    letters = list("ab  ²½ªº\x1c\x85\xa0éß_…\n\t'sl1.") + ["'ll", "  ", "word "]
    for t in range(700):
        text = "".join(r.choices(letters, k=r.choice([0, 3, 30, 300])))
        tree = ec.CountTree(encoder, text)
        for _ in range(r.randint(1, 10)):
            at, cut = r.randint(0, len(text) + 2), r.choice([0, 0, 1, 2, 5, 40])
            new = "".join(r.choices(letters, k=r.choice([0, 1, 2, 200 if t % 7 == 0 else 3])))
            tree.edit(at, cut, new)
            at = min(at, len(text))
            text = text[:at] + new + text[at + cut :]
            assert tree.text() == text and tree.n_chars == len(text)
            assert tree.n_tokens == len(encoder.encoding.encode_ordinary(text))


def test_few_pre_tokens_are_encoded(encoder):
    text = "some words in a row, " * 5000
    tree = ec.CountTree(encoder, text)
    tree.edit(50_000, 3, "new")
    assert tree.encoded < 12 and tree.n_tokens == len(encoder.encoding.encode_ordinary(tree.text()))


def test_table(spark, encoder):
    edits = [(2, 1, "x"), (None, None, None), (10**6, 5, " end"), (0, -3, "")]
    rows = [(1, "hello world", edits, "c"), (2, None, edits[:1], "c"), (3, "a b", None, "c"), (None, "", [None], "c"), (4, "w " * 60000, edits, "c"), (1, "hello world", edits, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<at:long,delete:long,insert:string>>, n_tokens string")
    got = ec.edited_counts(df, PATH, P.PATTERN).collect()
    assert [g.text for g in got][:4] == ["hexlo world end", "x", "a b", ""] and got[0] == got[5]
    for g in got:
        assert g.n_tokens == len(encoder.encoding.encode_ordinary(g.text))
    assert ec.edited_counts(spark.createDataFrame([], df.schema), PATH, P.PATTERN).count() == 0
