import random
import zlib

from netquarry.llm import sharding

SCHEMA = "doc_id long, text string, shard string, _text string"


def test_schedule_takes_the_least_loaded():
    assert sharding.schedule([5, 9, 4, 4], 2) == [1, 0, 1, 0]
    assert sharding.schedule([], 3) == []


def _check(rows, got, shards, apart):
    assert len(got) == len(rows)
    home, load, slots = {}, [0] * shards, [[] for _ in range(shards)]
    for g in got:
        assert home.setdefault((g.text_crc32, g.size), g.shard) == g.shard
        load[g.shard] += g.size
        slots[g.shard].append(g.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert sorted((g.size, g.text_crc32) for g in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert max(load) - min(load) <= apart


def test_sizes_are_nearly_equal_and_groups_whole(spark):
    r = random.Random(1)
    rows = [(i, "é" * r.randint(0, 300) + str(i), "x", "y") for i in range(3000)]
    rows += [(5000 + i, "copy", "x", "y") for i in range(200)] + [(None, None, "x", "y"), (1, "", "x", "y"), (1, "", "x", "y")]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 7).collect()
    total = sum(g.size for g in got)
    _check(rows, got, 7, total / 7 * 0.01)


def test_a_group_above_a_shards_share_stays_whole(spark):
    rows = [(i, "hot text " * 30, "x", "y") for i in range(100)] + [(200 + i, f"t{i}", "x", "y") for i in range(300)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert len({g.shard for g in got if g.doc_id < 100}) == 1
    rest = [sum(g.size for g in got if g.shard == s) for s in range(4) if s != got[[g.doc_id for g in got].index(0)].shard]
    assert max(rest) - min(rest) < 60


def test_many_small_buckets_and_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "IN_BUCKET", 50)
    monkeypatch.setattr(sharding, "MOST_LOTS", 40)
    r = random.Random(2)
    rows = [(i, "é" * r.randint(0, 300) + str(i), "x", "y") for i in range(3000)] + [(9000, "long " * 20_000, "x", "y")]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 5).collect()
    _check(rows, got, 5, sum(g.size for g in got) / 5 * 0.2)


def test_few_rows_and_none(spark):
    got = sharding.shard(spark.createDataFrame([(1, "a", "x", "y")], SCHEMA), 40).collect()
    assert len(got) == 1 and got[0].slot == 0
    assert sharding.shard(spark.createDataFrame([], SCHEMA), 40).count() == 0
