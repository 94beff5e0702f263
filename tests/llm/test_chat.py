"""Layouts, template and loss mask of conversations, by exact round trips."""

import hashlib
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenlake.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROL, *(c[1:] for c in chat.CONTROL), *(c[:-1] for c in chat.CONTROL), "<", "[", "\\", "<\\", "\\s>", "/", " ", "\n", "\n\n", "é", "😀", "x", " </s>", " [/INST]", "\n<<END>>\n"]), max_size=8).map("".join)
ROLES = st.sampled_from(["user", "assistant", "system", "", "tool", "</s>", "<</ROLE>>", "a\nb", "\\"])


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_escapes_are_reversible_and_hide_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLES, PIECES), max_size=6))
def test_parsing_undoes_formatting(turns):
    text = chat.BEGIN
    for role, said in turns:
        opening, close = chat._marks(role)
        text += opening + chat.escape(said) + close
    assert list(chat.parse(text)) == turns


RECORDS = {
    "messages": {"messages": [{"role": "system", "content": "be"}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]},
    "messages-parts": {"messages": [{"role": "user", "content": [{"type": "text", "text": "h"}, {"type": "text", "text": "i"}]}]},
    "conversations": {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}, {"from": "tool", "value": "t"}]},
    "prompt-completion": {"prompt": "hi", "completion": "yo"},
    "prompt-response": {"system": "be", "prompt": "hi", "response": "yo"},
    "instruction-output": {"instruction": "do", "input": "this", "output": "done"},
    "instruction-response": {"instruction": "do", "context": "", "response": "done"},
    "question-answer": {"question": "q", "answer": "a", "system": ""},
}
TURNS = {
    "messages": [("system", "be"), ("user", "hi"), ("assistant", "")],
    "messages-parts": [("user", "hi")],
    "conversations": [("user", "hi"), ("assistant", "yo"), ("tool", "t")],
    "prompt-completion": [("user", "hi"), ("assistant", "yo")],
    "prompt-response": [("system", "be"), ("user", "hi"), ("assistant", "yo")],
    "instruction-output": [("user", "do\n\nthis"), ("assistant", "done")],
    "instruction-response": [("user", "do"), ("assistant", "done")],
    "question-answer": [("user", "q"), ("assistant", "a")],
}


def gathered(df):
    out = {}
    for r in df.orderBy("conv_id", "turn").collect():
        out.setdefault(r.conv_id, []).append((r.layout, r.role, r.text))
    return out


def test_json_records_of_all_layouts(spark):
    names = list(RECORDS)
    rows = [(k, json.dumps({"id": k, "meta": {"x": [1]}, **RECORDS[n]})) for k, n in enumerate(names)]
    odd = ["", None, "no json", "[1]", "7", '{"prompt": "alone"}', '{"messages": []}', "[" * 5000, '{"prompt": 5, "completion": ["a", {"b": 1}]}']
    rows += [(100 + k, r) for k, r in enumerate(odd)]
    df = spark.createDataFrame(rows, "conv_id long, record string").withColumn("turn", F.lit("x")).repartition(3)
    got = gathered(chat.json_turns(df))
    for k, n in enumerate(names):
        assert got[k] == [(n, *t) for t in TURNS[n]], n
    for k, r in enumerate(odd[:6]):
        assert got[100 + k] == [(None, None, r)]
    assert 106 not in got  # known, but without turns
    assert got[107][0][0] is None and got[108][0] == (None, None, odd[8])  # paths are those of a list's fields
    back = chat.format_and_read(chat.json_turns(df)).collect()
    assert sorted(r.conv_id for r in back) == list(range(len(names)))


def test_tables_of_all_layouts(spark):
    for name, record in RECORDS.items():
        schema = spark.range(1).select(F.schema_of_json(json.dumps(record))).first()[0]
        df = spark.createDataFrame([(1, json.dumps(record)), (2, json.dumps(record))], "conv_id long, j string").select("conv_id", F.from_json("j", schema).alias("r")).select("conv_id", "r.*")
        got = gathered(chat.table_turns(df))
        assert got == {1: [(name, *t) for t in TURNS[name]], 2: [(name, *t) for t in TURNS[name]]}, name
    assert gathered(chat.json_turns(spark.createDataFrame([(1, json.dumps(RECORDS["messages"]))], "conv_id long, record string")))[1] == [("messages", *t) for t in TURNS["messages"]]


def test_an_unknown_table_is_refused(spark):
    try:
        chat.table_turns(spark.createDataFrame([(1, "x")], "conv_id long, words string"))
    except ValueError as e:
        assert "fingerprint" in str(e)
    else:
        raise AssertionError


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = [x[3] for x in turns if x[2] == "assistant"]
        shaped = chat.BEGIN + "".join(chat._marks(r)[0] + chat.escape(x) + chat._marks(r)[1] for _, _, r, x in turns)
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(), len("".join(said)), hashlib.sha256("".join(said).encode()).hexdigest(), len(shaped))
    return out


def test_formatting_equals_a_plain_version(spark):
    rng = random.Random(4)
    pieces = ["é", "[INST]", "</s>", "<\\/s>", "😀", "words of a text", "\n", "<<SYS>>"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "tool", None]), rng.choice([None, "", "".join(rng.choice(pieces) for _ in range(9))])) for c in [*range(60), None] for t in rng.choice([[0], [0, 1, 2], [None, 0, 0, 5, 5]])]
    rows += [(500, t, "assistant" if t % 2 else "user", "y" * (t % 50) + "</s>") for t in range(3000)] + rows[:3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    want = plain(rows)
    for chunk in (chat.CHUNK, 300):
        turns = chat.table_turns(df, order="turn")
        written = spark.read.parquet(chat.write(turns, chunk=chunk))
        assert (written.count() > len(want)) == (chunk == 300)
        got = {r[0]: tuple(r[1:]) for r in chat.read_back(written).collect()}
        assert got == want


def test_no_conversations_and_long_ones(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.format_and_read(chat.table_turns(spark.createDataFrame([], schema), order="turn")).collect() == []
    rows = [(1, 0, "user", "[INST]" * 300_000), (1, 1, "assistant", "é" * 2_000_000), (1, 2, "assistant", "z")]
    got = chat.format_and_read(chat.table_turns(spark.createDataFrame(rows, schema), order="turn")).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == plain(rows)
