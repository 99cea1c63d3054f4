from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.llm import chat as C

TURNS = "conv_id long, turn long, role string, text string"
EVENTS = "conv_id long, seq long, message_id long, kind string, role string, text string"
_java = lambda p: p.replace("$", "\\")


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="<>/[]\\sINTSY ", max_size=30))
def test_escape_is_undone(text):
    put = re.sub(C._CONTROL, r"\1\\\2\3", text)
    assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>", put)
    assert re.sub(C._ESCAPED, r"\1\2\3", put) == text


def back(spark, rows):
    log = C.events_of_turns(spark.createDataFrame(rows, TURNS))
    return {r.conv_id: ([tuple(t) for t in r.turns], list(r.loss_texts), r.formatted, [tuple(s) for s in C_spans(spark, log, r.conv_id)]) for r in C.read_back(C.format_conversations(log)).collect()}


def C_spans(spark, log, conv):
    rows = [r for r in C.format_conversations(log).collect() if r.conv_id == conv]
    return rows[0].loss_spans


def test_turns_and_mask(spark):
    rows = [
        (1, 0, "user", "hi </s>[INST] <"), (1, 1, "assistant", "[/INST]\\ é<"), (1, 3, "user", None), (1, 2, "assistant", "</s>"), (2, 0, "tool<s>", "a"), (2, 0, None, "b"), (2, 0, "tool<s>", "a"),
        (None, 5, "user", ""), (3, 1, "assistant", "x" * 10000),
    ]
    got = back(spark, rows)
    assert got[1][0] == [("user", "hi </s>[INST] <"), ("assistant", "[/INST]\\ é<"), ("assistant", "</s>"), ("user", "")]
    assert got[1][1] == ["[/INST]\\ é<", "</s>"]
    assert got[2][0] == [("", "b"), ("tool<s>", "a"), ("tool<s>", "a")] and got[2][1] == []
    assert got[None][0] == [("user", "")]
    for turns, loss, formatted, spans in got.values():
        cut = [re.sub(C._ESCAPED, r"\1\2\3", formatted[s : s + n]) for _, s, n in spans]
        assert cut == loss == [t for r, t in turns if r == "assistant"]


def test_mask_is_read_by_its_start(spark):
    rows = [(1, 0, "assistant", "é☃" * 3000), (1, 1, "user", "ask"), (1, 2, "assistant", "tell </s>" * 900)]
    done = C.format_conversations(C.events_of_turns(spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", seq string")))
    assert list(C.read_back(done).first().loss_texts) == ["é☃" * 3000, "tell </s>" * 900]
    moved = done.withColumn("loss_spans", F.expr("transform(loss_spans, s -> named_struct('turn', s.turn, 'start', s.start + 1, 'length', s.length))"))
    assert C.read_back(moved).first().loss_texts[0] == "é☃"[1:] + "é☃" * 2999 + "<"


def test_log_of_turns_holds_every_kind(spark):
    log = C.events_of_turns(spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "good day")], TURNS)).orderBy("seq").collect()
    assert [(r.kind, r.text) for r in log] == [
        ("message", "he"), ("edit", "hello"), ("message", ""), ("delta", "good"), ("regenerate", ""), ("delta", "good"), ("delta", " day"),
    ]


def test_folding(spark):
    log = [
        (1, 1, 10, "message", "user", "hi"), (1, 2, 11, "message", "assistant", "He"), (1, 3, 11, "delta", None, "llo"), (1, 4, 12, "message", "user", "more"), (1, 5, 13, "message", "assistant", "old"),
        (1, 6, 10, "edit", None, "hey"), (1, 7, 11, "regenerate", None, None), (1, 9, 11, "delta", None, "new"), (1, 8, 11, "delta", None, "A "), (1, 10, 14, "message", "user", "last"),
        (2, 1, 1, "delta", "assistant", "lone"), (2, 2, 1, "delta", None, None), (3, 1, 1, None, None, "x"),
    ]
    got = {}
    for r in C.fold_events(spark.createDataFrame(log, EVENTS)).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {1: [("user", "hey"), ("assistant", "A new"), ("user", "last")], 2: [("assistant", "lone")], 3: [("", "x")]}


def test_empty_and_native(spark):
    none = C.events_of_turns(spark.createDataFrame([], TURNS))
    done = C.read_back(C.format_conversations(none))
    assert done.count() == 0
    assert not re.search("Python|Pandas|Arrow", done._jdf.queryExecution().executedPlan().toString())


def test_query(spark, sf_dir):
    from quillmesh.llm.queries import ORACLE, op10_chat_format
    from tests.oracle import compare, connection

    compare(op10_chat_format(spark, sf_dir), connection(sf_dir), ORACLE["op10_chat_format"])
