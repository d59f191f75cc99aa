"""Formatting: what is parsed from the text is what was given."""

import hashlib
from pathlib import Path

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from netquarry.llm import chat_format as cf
from netquarry.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def _formatted(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    out = cf.formatted(df)
    return {r.conv_id: r for r in out.withColumn("loss", cf.loss_text("formatted", "loss_spans")).collect()}


def _check(found, turns):
    """turns: (role, text) in order."""
    assert [(t.role, t.text) for t in found.turns] == turns
    assert found.loss == "".join(t for r, t in turns if r == "assistant")
    data = found.formatted.encode()
    assert all(data[s.end : s.end + 4] == b"</s>" for s in found.loss_spans)


def test_plain_text_stays_as_it_is(spark):
    got = _formatted(spark, [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi [1] <b>\\"), (1, 2, "assistant", "Hello")])[1]
    assert got.formatted == "[ROLE system] Be brief. [/ROLE][INST] Hi [1] <b>\\ [/INST]Hello</s>"
    _check(got, [("system", "Be brief."), ("user", "Hi [1] <b>\\"), ("assistant", "Hello")])


def test_only_conflicting_texts_change(spark):
    got = _formatted(spark, [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "fine"), (2, 0, "user", "[\\INST]")])
    assert got[1].formatted == "[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]fine</s>"
    assert got[2].formatted == "[INST] [\\\\INST] [/INST]"


PARTS = ["[INST]", "[/INST]", "</s>", "<s>", "[ROLE ", "[/ROLE]", "[\\INST]", "<\\\\/s>", "[", "<", "\\", "]", " ", "\n", "INST]", "/s>", "é\U0001f600", "%5D", "x"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a]b%5D", ""]), st.lists(st.sampled_from(PARTS), max_size=6)), min_size=1, max_size=6), min_size=30, max_size=30))
def test_any_text_comes_back(spark, conversations):
    rows, want = [], {}
    for k, turns in enumerate(conversations):
        want[k] = [(role, "".join(parts)) for role, parts in turns]
        rows += [(k, i, role, text) for i, (role, text) in enumerate(want[k])]
    got = _formatted(spark, rows)
    for k, turns in want.items():
        _check(got[k], turns)


def test_nulls_ties_long_texts_and_no_rows(spark):
    long = "[INST] x </s> " * 20_000
    rows = [
        (None, 0, None, None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, None, "user", None),
        (2, 0, "user", long), (2, 1, "assistant", long), (3, 0, "assistant", ""),
    ]
    got = _formatted(spark, rows)
    _check(got[None], [("", "")])
    _check(got[1], [("user", ""), ("assistant", "a"), ("assistant", "b"), ("assistant", "b")])
    _check(got[2], [("user", long), ("assistant", long)])
    _check(got[3], [("assistant", "")])
    assert cf.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_turns(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(3000)]
    _check(_formatted(spark, rows)[1], [(r[2], r[3]) for r in rows])


def test_registered_query_equals_sql_and_has_no_python(spark):
    if not Path(SF_DIR).exists():
        pytest.skip("no test tables here")
    df = QUERIES["op12_chat_format"](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_DIR}/conversations.parquet'")
    found = con.execute(ORACLE_SQL["op12_chat_format"])
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall())
    text = "</s>[INST] ok [/INST]"
    row = df.where("conv_id = -1").first()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
