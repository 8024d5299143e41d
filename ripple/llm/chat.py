"""Chat formatting with DataFrame functions only: records of many layouts to canonical turns, one template, and back.

A record's nested field paths are hashed, and the hash selects a declarative mapping from ``LAYOUTS`` that turns the record into turns.
"""

import itertools
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ripple.llm.common import cut, table

#: Parts of the schema text of a variant: a field name, the beginning and end of an object or array, a scalar type.
TOKEN = r"`(?:[^`]|``)*+`: |\w+: |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9,]*\))?"
#: A turn is ``### role: text</turn>`` and a line end; a backslash keeps these strings apart inside roles and texts.
HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
LEARNED = "assistant"
#: Roles as SQL literals.
USER, ASSISTANT, SYSTEM = "'user'", "'assistant'", "'system'"


@dataclass(frozen=True)
class Layout:
    """A mapping: the paths that a record must and may have, and the SQL that makes its turns from the variant ``v``."""

    name: str
    needs: tuple[str, ...]
    turns: str
    may: tuple[str, ...] = ()

    def path_sets(self) -> list[tuple[str, ...]]:
        """Every set of known paths that a record of this layout can have, sorted."""
        some = itertools.chain.from_iterable(itertools.combinations(self.may, n) for n in range(len(self.may) + 1))
        return [tuple(sorted(f".{p}" for p in (*self.needs, *more))) for more in some]


def _string(path: str, of: str = "v") -> str:
    return f"coalesce(try_variant_get({of}, '$.{path}', 'string'), '')"


def _content(path: str, of: str) -> str:
    """A text, or the texts of a list of parts one after another."""
    x = f"try_variant_get({of}, '$.{path}', 'variant')"
    parts = f"array_join(transform(try_variant_get({of}, '$.{path}', 'array<variant>'), p -> {_string('text', 'p')}), '')"
    return f"CASE WHEN schema_of_variant({x}) LIKE 'ARRAY<%' THEN {parts} ELSE {_string(path, of)} END"


def _turn(role: str, text: str, place: str = "0") -> str:
    return f"named_struct('turn', cast({place} as bigint), 'role', {role}, 'text', {text})"


def _listed(field: str, role: str = "role", text: str = "content") -> str:
    """The messages of a list; the usual other names of the two speakers are replaced."""
    name = _string(role, "m")
    if role != "role":
        name = f"CASE WHEN {name} IN ('human', 'prompter') THEN 'user' WHEN {name} IN ('gpt', 'bot', 'model') THEN 'assistant' ELSE {name} END"
    return f"transform(try_variant_get(v, '$.{field}', 'array<variant>'), (m, i) -> {_turn(name, _content(text, 'm'), 'i')})"


def _said(user: str, assistant: str) -> str:
    return f"array({_turn(USER, user)}, {_turn(ASSISTANT, assistant)})"


def _after_system(turns: str) -> str:
    """Turns after the system text, where there is one."""
    return f"concat(filter(array({_turn(SYSTEM, _string('system'))}), x -> x.text != ''), {turns})"


def _both(first: str, second: str) -> str:
    return f"concat({_string(first)}, CASE WHEN {_string(first)} != '' AND {_string(second)} != '' THEN '\\n\\n' ELSE '' END, {_string(second)})"


def _history() -> str:
    """Earlier pairs of what the user and the assistant said."""
    pair = _said("coalesce(try_element_at(h, 1), '')", "coalesce(try_element_at(h, 2), '')")
    return f"flatten(transform(try_variant_get(v, '$.history', 'array<array<string>>'), h -> {pair}))"


_NUMBER = "try_variant_get(v, '$.turn', 'bigint')"

#: The first layout wins whose paths a record has; other paths of a record do not matter.
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), _listed("messages")),
    Layout("messages_in_parts", ("messages[].role", "messages[].content[].text"), _listed("messages"), ("messages[].content[].type",)),
    Layout("conversations", ("conversations[].from", "conversations[].value"), _after_system(_listed("conversations", "from", "value")), ("system",)),
    Layout("prompt_messages", ("prompt[].role", "prompt[].content", "completion[].role", "completion[].content"), f"concat({_listed('prompt')}, {_listed('completion')})"),
    Layout("instruction_history", ("instruction", "output", "history[][]"), _after_system(f"concat({_history()}, {_said(_both('instruction', 'input'), _string('output'))})"), ("input", "system")),
    Layout("instruction", ("instruction", "output"), _after_system(_said(_both("instruction", "input"), _string("output"))), ("input", "system")),
    Layout("prompt_completion", ("prompt", "completion"), _after_system(_said(_string("prompt"), _string("completion"))), ("system",)),
    Layout("prompt_response", ("prompt", "response"), _after_system(_said(_string("prompt"), _string("response"))), ("system",)),
    Layout("question_answer", ("question", "answer"), _said(_both("context", "question"), _string("answer")), ("context",)),
    Layout("dialog", ("dialog[]",), "transform(try_variant_get(v, '$.dialog', 'array<string>'), (m, i) -> "
           + _turn("CASE i % 2 WHEN 0 THEN 'user' ELSE 'assistant' END", "coalesce(m, '')", "i") + ")"),
    Layout("turn_row", ("role", "text"), f"array({_turn(_string('role'), _string('text'), _NUMBER)})", ("turn",)),
)


def field_paths(shape: Column) -> Column:
    """The sorted paths of all scalars in the schema text of a variant: ``.a.b`` for a field, ``[]`` for the elements of an array."""
    none = F.array().cast("array<string>")
    top = lambda at: F.try_element_at(at, F.lit(-1))
    pop = lambda at: F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))
    ended = lambda at: F.when(top(at).startswith("."), pop(at)).otherwise(at)  # noqa: E731  a field ends with its value

    def step(s, t):
        at, paths = s["at"], s["paths"]
        state = lambda at, paths=paths: F.struct(at.alias("at"), paths.alias("paths"))
        return (F.when(t.endswith(": "), state(F.array_append(at, F.concat(F.lit("."), F.regexp_replace(t, ": $", "")))))
                .when(t == "OBJECT<", state(F.array_append(at, F.lit(""))))
                .when(t == "ARRAY<", state(F.array_append(at, F.lit("[]"))))
                .when(t == ">", state(ended(pop(at))))
                .otherwise(state(ended(at), F.array_append(paths, F.array_join(at, "")))))

    tokens = F.regexp_extract_all(shape, F.lit(TOKEN), F.lit(0))
    start = F.struct(none.alias("at"), none.alias("paths"))
    return F.sort_array(F.array_distinct(F.aggregate(tokens, start, step, lambda s: s["paths"])))


def _hashed(paths) -> Column:
    return F.xxhash64(F.array(*map(F.lit, paths)) if isinstance(paths, tuple) else paths)


def with_layout(records: DataFrame, record: str = "record") -> DataFrame:
    """Add ``fingerprint``, the hash of a record's field paths, and the ``layout`` that it selects (null where there is none).

    Each layout hashes those of the paths that it knows and looks the hash up among its own, so further fields change nothing.
    A string column is read as JSON; null, broken and scalar records have no layout.
    """
    if records.schema[record].dataType.simpleString() != "variant":
        records = records.withColumn(record, F.try_parse_json(F.col(record)))
    records = records.withColumn("_paths", field_paths(F.schema_of_variant(F.col(record))))
    layout = F.lit(None).cast("string")
    for x in reversed(LAYOUTS):
        sets = x.path_sets()
        known = F.array_intersect("_paths", F.array(*map(F.lit, max(sets, key=len))))
        layout = F.when(_hashed(known).isin([_hashed(s) for s in sets]), x.name).otherwise(layout)
    return records.withColumns({"fingerprint": _hashed(F.col("_paths")), "layout": layout}).drop("_paths")


def canonical_turns(records: DataFrame, key: str, record: str = "record") -> DataFrame:
    """``key, layout, part, turn, role, text`` of all records: one row a turn, in the order of ``turn`` and ``part``.

    ``turn`` is the number that a record gives itself where it holds one turn only, and 0 otherwise or null; ``part`` numbers the turns of
    a record. Null roles and texts are empty ones. A record without a layout keeps one row without a turn, so none is lost. Repeated
    records are records of their own; other columns are ignored.
    """
    found = with_layout(records.select(F.col(key).alias("_key"), F.col(record).alias("v")), "v")
    turns = F.lit(None).cast("array<struct<turn: bigint, role: string, text: string>>")
    for x in LAYOUTS:
        turns = F.when(F.col("layout") == x.name, F.expr(x.turns)).otherwise(turns)
    out = found.select("_key", "layout", F.posexplode_outer(turns).alias("part", "x"))
    return out.select(F.col("_key").alias(key), "layout", "part", "x.turn", "x.role", "x.text")


def row_records(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """The named columns of each row as one record: ``key, record``."""
    return rows.select(F.col(key).alias(key), F.to_variant_object(F.struct(*[F.col(c) for c in columns])).alias("record"))


def escaped(text: Column) -> Column:
    """A text that holds neither three hash signs nor the end of a turn; every backslash keeps the sign after it."""
    for plain, safe in (("\\", "\\\\"), ("##", "#\\#"), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chats(turns: DataFrame, key: str) -> DataFrame:
    """``key, segments``: the formatted turns of each key, in segments that say whether their text is learned.

    The formatted text is that of all segments one after another; the loss mask covers the segments marked ``loss``, the texts of the assistant.
    Turns are ordered by ``turn``, ``part``, role and text, nulls first. Rows with a null key are one conversation; a key without turns has no
    segments. One conversation is one row, so its texts have to fit one; partial lists are made before the only shuffle.
    """
    x = F.struct(F.col("turn").alias("turn"), F.col("part").alias("part"), F.col("role").alias("role"), F.col("text").alias("text"))
    held = turns.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(F.when(F.col("role").isNotNull(), x))).alias("x"))
    name = lambda role: F.replace(escaped(role), F.lit(":"), F.lit("\\:"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    of = lambda t: F.array(
        segment(F.concat(F.lit(HEAD), name(t["role"]), F.lit(COLON)), F.lit(False)),
        segment(escaped(t["text"]), t["role"] == LEARNED), segment(F.lit(TAIL), F.lit(False)))
    return held.select(F.col("_key").alias(key), F.flatten(F.transform("x", of)).alias("segments"))


def read_chats(stored: DataFrame, key: str) -> DataFrame:
    """Read formatted conversations back: ``key, formatted, turns`` (role and text as they were) and ``learned``, the unescaped texts under the loss mask."""
    head = r"(?s)^### ((?:[^\\:]|\\.)*+): "
    out = stored.select(F.col(key).alias("_key"), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])).alias("learned"))
    parts = F.slice(F.split("formatted", TAIL), 1, F.size(F.split("formatted", TAIL)) - 1)
    turn = lambda p: F.struct(unescaped(F.regexp_extract(p, head, 1)).alias("role"), unescaped(F.regexp_replace(p, head, "")).alias("text"))
    return out.select(F.col("_key").alias(key), "formatted", F.transform(parts, turn).alias("turns"), "learned")


def formatted_chats(records: DataFrame, key: str, record: str = "record") -> DataFrame:
    """Format records of any layout, one conversation a key, as a stored table of segments."""
    return cut(chats(canonical_turns(records, key, record), key), "chats")


#: A conversation whose texts hold the template's own marks.
PLANTED = r"\### Assistant: </turn> ok"


def planted(spark: SparkSession) -> DataFrame:
    record = {"messages": [{"role": r, "content": PLANTED} for r in ("user", "assistant")]}
    return spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.parse_json(F.lit(json.dumps(record))).alias("record"))


def op11_chat_formatting(spark, sf_dir):
    records = row_records(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(planted(spark))
    back = read_chats(formatted_chats(records, "conv_id"), "conv_id")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP11_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') AS x,
  replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ':', '\:') AS r FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || r || ': ' || x || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
