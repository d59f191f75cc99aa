import random
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from netquarry.llm import packing
from netquarry.llm.word_tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(PATH)


def test_ids_equal_the_library(encoder):
    library = Tokenizer.from_file(PATH)
    r = random.Random(1)
    letters = [chr(i) for i in range(0x250)] + list("'stredvml  %.,") * 20 + ["<|endoftext|>", "Σ", "İ", "e\u0301", "漢", "\u2028"]
    texts = ["", "it's they're I'LL", "½ ² 12 ٣ a_b %%%", "<|startoftext|> hi"] + ["".join(r.choices(letters, k=r.randint(0, 30))) for _ in range(1500)]
    for t in texts:
        data = encoder.encode(t)
        assert list(struct.unpack(f"<{len(data) // 4}I", data)) == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert encoder.encode(None) == b""


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_document_once(seed):
    r = random.Random(seed)
    width = r.choice([16, 100, 512])
    histogram = dict(Counter(min(width, int(r.lognormvariate(r.uniform(1, 5), 1)) + 1) for _ in range(r.choice([1, 50, 5000]))))
    shapes = packing.plan(histogram, width)
    used = Counter()
    for shape, n in shapes:
        assert n > 0 and sum(shape) <= width
        for length in shape:
            used[length] += n
    assert used == histogram
    tokens = sum(k * n for k, n in histogram.items())
    long = sum(n for k, n in histogram.items() if 2 * k > width)
    assert sum(n for _, n in shapes) <= max(-(-tokens // width), long) * 1.05 + 2


def test_least_squares_meets_a_histogram_that_patterns_can_meet():
    import numpy as np

    counts = np.zeros(11)
    counts[[3, 7, 5]] = [40, 40, 20]
    x = packing.fit(np.array([(7, 3, 0), (5, 5, 0), (3, 3, 3)]), counts, steps=3000)
    assert abs(x[0] - 40) < 0.5 and abs(x[1] - 10) < 0.2 and x[2] < 0.5


def test_most_documents_are_packed_by_the_fit():
    import numpy as np

    r = np.random.default_rng(1)
    width = 512
    counts = np.bincount(np.minimum(width - 1, r.lognormal(4.5, 0.9, 50_000).astype(int) + 1), minlength=width + 1).astype(float)
    lengths = np.flatnonzero(counts)
    shapes = packing.patterns(lengths, counts[lengths], width)
    made = np.zeros(width + 1)
    np.add.at(made, shapes, packing.rounded(packing.fit(shapes, counts))[:, None])
    assert np.minimum(made, counts)[1:].sum() > 0.8 * counts.sum()


def test_empty_histogram():
    assert packing.plan({}, 8) == []


SCHEMA = "doc_id long, text string, length int, _rank string"


def test_pieces_are_packed_without_gaps(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "x1"]) for _ in range(r.choice([0, 1, 5, 20, 60]))), 1, "x") for i in range(150)]
    rows += [(1000, None, 1, "x"), (1001, "", 1, "x"), (1002, "word " * 5000, 1, "x"), (7, rows[7][1], 1, "x"), (None, "a b", 1, "x")]
    rows += [(2000 + i, "hot text", 1, "x") for i in range(300)]
    width = 32
    got = packing.pack(packing.tokenize(spark.createDataFrame(rows, SCHEMA), PATH, width, 1), width).collect()
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), width):
            part = ids[k : k + width]
            want[(i, k // width, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    places = {}
    for g in got:
        places.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= width
    assert len(places) <= -(-sum(g.length for g in got) // width) * 1.03 + 1


def test_empty_table(spark):
    assert packing.pack(packing.tokenize(spark.createDataFrame([], SCHEMA), PATH, 32, 1), 32).count() == 0
