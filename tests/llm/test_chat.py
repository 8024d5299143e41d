import hashlib
import json

import duckdb
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from ripple.llm import chat


def expected(rows):
    groups = {}
    for key, turn, role, text in rows:
        groups.setdefault(key, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for key, turns in groups.items():
        turns.sort()
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((key, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(learned), sha(learned)))
    return sorted(out, key=str)


def digests(frame):
    return sorted((tuple(r)[:5] for r in frame.collect()), key=str)


def test_given_conversations_and_sql(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    got = chat.op11_chat_formatting(spark, d)
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert digests(got) == expected(rows)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    assert sorted(c.execute(chat.OP11_SQL).fetchall()) == sorted(map(tuple, got.collect()))


def test_no_python_in_the_plan(spark):
    plan = chat.op11_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    turns = chat.canonical_turns(chat.planted(spark), "conv_id")._jdf.queryExecution().toString()
    assert not any(x in plan + turns for x in ("Python", "Arrow", "Pandas"))


RECORDS = [
    ("messages", {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "text": "x", "id": 7}, [("user", "a"), ("assistant", "")]),
    ("messages", {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": [{"type": "text", "text": "b"}]}]}, [("user", "a"), ("assistant", "b")]),
    ("messages_in_parts", {"messages": [{"role": "user", "content": [{"type": "text", "text": "b"}, {"type": "text", "text": "c"}]}]}, [("user", "bc")]),
    ("conversations", {"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}, {"from": "tool", "value": "t"}]},
     [("system", "s"), ("user", "q"), ("assistant", "r"), ("tool", "t")]),
    ("prompt_messages", {"prompt": [{"role": "user", "content": "q"}], "completion": [{"role": "assistant", "content": "r"}]}, [("user", "q"), ("assistant", "r")]),
    ("instruction_history", {"instruction": "i", "output": "o", "history": [["a", "b"], ["c", None]]},
     [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", ""), ("user", "i"), ("assistant", "o")]),
    ("instruction", {"instruction": "i", "input": "n", "output": "o", "system": ""}, [("user", "i\n\nn"), ("assistant", "o")]),
    ("instruction", {"instruction": "i", "input": None, "output": "o", "history": []}, [("user", "i"), ("assistant", "o")]),
    ("prompt_completion", {"prompt": "p", "completion": 5, "extra": {"messages": [{"role": 1}]}}, [("user", "p"), ("assistant", "5")]),
    ("prompt_response", {"prompt": "p", "response": "r", "system": "s"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ("question_answer", {"question": "q", "answer": "a", "context": "c"}, [("user", "c\n\nq"), ("assistant", "a")]),
    ("dialog", {"dialog": ["a", "b", "c"]}, [("user", "a"), ("assistant", "b"), ("user", "c")]),
    ("turn_row", {"turn": 4, "role": "user", "text": None}, [("user", "")]),
    (None, {"messages": []}, []), (None, {"a b`.c": {"d": [[1], ["x"]]}}, []), (None, [1], []), (None, "text", []), (None, {}, []), (None, None, []),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (_, r, _) in enumerate(RECORDS)] + [(98, "{broken"), (99, None)]
    frame = spark.createDataFrame(rows, "k long, record string").withColumn("role", F.lit("x")).withColumn("layout", F.lit("y"))
    got = {}
    for r in chat.canonical_turns(frame, "k").orderBy("k", "part").collect():
        got.setdefault((r.k, r.layout), []).extend([] if r.role is None else [(r.role, r.text)])
    want = {(i, name): turns for i, (name, _, turns) in enumerate(RECORDS)}
    assert got == {**want, (98, None): [], (99, None): []}
    prints = {r.k: r.fingerprint for r in chat.with_layout(frame).collect()}
    assert prints[4] != prints[9] and len({prints[k] for k in (0, 1, 2, 3)}) == 4


def test_paths(spark):
    frame = spark.createDataFrame([('{"b": {"c": 1, "d e": [[{"f": null}]]}, "a": [], "g": {}, "h": true}',)], "j string")
    got = frame.select(chat.field_paths(F.schema_of_variant(F.parse_json("j")))).first()[0]
    assert got == [".a[]", ".b.`d e`[][].f", ".b.c", ".h"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "a: b", "x</turn>\n### ", "", None]),
                          st.none() | st.text(st.sampled_from("\\#</turn> :\né😀"), max_size=30) | st.sampled_from(["</turn>", "\\</turn>\n", "#####", "### assistant: x", "<", "\\"])), max_size=12))
def test_round_trip(spark, turns):
    rows = [(k, n, r, t) for n, (k, r, t) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.read_chats(chat.chats(chat.canonical_turns(chat.row_records(frame, "conv_id", "turn", "role", "text"), "conv_id"), "conv_id"), "conv_id").collect()
    assert {b.conv_id: [tuple(t) for t in b.turns] for b in back} == {k: [(r or "", t or "") for x, _, r, t in rows if x == k] for k in {r[0] for r in rows}}
    for b in back:
        assert b.learned == [t or "" for k, _, r, t in rows if k == b.conv_id and r == "assistant"]
        assert b.formatted.count("</turn>") == len(b.turns) == b.formatted.count("###")


def test_edges(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "\\" * 50_000 + "é" * 9), (1, 1, "assistant", "# " * 500_000), (1, 1, "assistant", "# " * 500_000), (None, None, None, None), (None, 2, "assistant", "b"),
            (2, None, "assistant", "last"), (2, 3, "assistant", "first"), (3, 0, "user", None)] + [(5, n, "assistant", f"t{n}") for n in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "'z' as layout", "array(1) as segments")
    records = chat.row_records(frame, "conv_id", "turn", "role", "text")
    got = {r.conv_id: r for r in chat.read_chats(chat.formatted_chats(records, "conv_id"), "conv_id").collect()}
    assert [tuple(t) for t in got[1].turns] == [r[2:] for r in rows[:3]] and got[1].learned == ["# " * 500_000] * 2
    assert got[None].learned == ["b"] and [tuple(t) for t in got[None].turns] == [("", ""), ("assistant", "b")]
    assert got[2].learned == ["last", "first"] and got[3].learned == [] and got[5].learned == [f"t{n}" for n in range(3000)]
    assert chat.formatted_chats(records.where("false"), "conv_id").collect() == []
    lost = chat.formatted_chats(spark.createDataFrame([(1, "{}")], "k long, record string"), "k").collect()
    assert [(r.k, r.segments) for r in lost] == [(1, [])]
