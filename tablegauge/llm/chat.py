"""Conversations of many layouts as one training format.

A record is a variant. Its schema fingerprint is the hash of its nested field paths, whatever
the types and the order of its fields; the fingerprint selects a declarative mapping, which
turns the record into canonical turns (role, text). Turns are written with a template that
marks them and escapes control strings inside texts; ``parse`` reads them back. All of it is
built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: How control strings of common templates begin; each is broken up after its first character.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURNS = "array<struct<role:string,text:string>>"
TRAINED = "assistant"


@dataclass(frozen=True)
class Mapping:
    """A layout by an example of it, and where its turns are.

    ``turns`` is the path of an array of turns with the fields ``role`` and ``text``. Without
    it ``fields`` gives (role, path) pairs; paths of the same role in a row are joined by an
    empty line. A role that begins with $ is itself read from that path. ``roles`` gives the
    usual names of roles that the layout calls otherwise.
    """

    name: str
    example: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping("turn rows", '{"role": "", "text": ""}', fields=(("$.role", "$.text"),)),
    Mapping("messages", '{"messages": [{"role": "", "content": ""}]}', "$.messages"),
    Mapping("from and value", '{"conversations": [{"from": "", "value": ""}]}', "$.conversations",
            "from", "value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt", '{"prompt": "", "completion": ""}',
            fields=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("prompt and response", '{"prompt": "", "response": ""}',
            fields=(("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("question", '{"question": "", "answer": ""}',
            fields=(("user", "$.question"), ("assistant", "$.answer"))),
    Mapping("instruction", '{"instruction": "", "output": ""}',
            fields=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("instruction and input", '{"instruction": "", "input": "", "output": ""}',
            fields=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Mapping("system and prompt", '{"system": "", "prompt": "", "response": ""}',
            fields=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
)


def field_paths(record: Column) -> Column:
    """Nested field names of a variant in a fixed order, without the types of its leaves."""
    return F.regexp_replace(
        F.schema_of_variant(record),
        r"(?<=[:<] ?)(?:STRING|VOID|BIGINT|DOUBLE|BOOLEAN|DATE|BINARY|FLOAT|"
        r"DECIMAL\(\d+,\d+\)|TIMESTAMP(?:_NTZ)?)(?=[,>])", "_")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def _renamed(role: Column, names: tuple[tuple[str, str], ...]) -> Column:
    for other, name in names:
        role = F.when(role == other, F.lit(name)).otherwise(role)
    return role


def _turns(record: Column, mapping: Mapping) -> Column:
    if mapping.turns:
        kind = f"array<struct<`{mapping.role}`:string,`{mapping.text}`:string>>"
        return F.transform(
            F.variant_get(record, mapping.turns, kind),
            lambda t: F.struct(
                _renamed(t[mapping.role], mapping.roles).alias("role"),
                t[mapping.text].alias("text")))
    grouped: list[tuple[str, list[Column]]] = []
    for role, path in mapping.fields:
        text = F.variant_get(record, path, "string")
        if grouped and grouped[-1][0] == role:
            grouped[-1][1].append(F.nullif(text, F.lit("")))
        else:
            grouped.append((role, [text]))
    return F.array(*[
        F.struct(
            (F.variant_get(record, role, "string") if role.startswith("$") else F.lit(role))
            .alias("role"),
            (F.concat_ws("\n\n", *texts) if len(texts) > 1 else texts[0]).alias("text"))
        for role, texts in grouped])


def canonical(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Turns of a variant record; null if no mapping has its fingerprint.

    A null role or text is empty.
    """
    seen = fingerprint(record)
    chosen = F.lit(None).cast(TURNS)
    for mapping in reversed(mappings):
        known = fingerprint(F.parse_json(F.lit(mapping.example)))
        chosen = F.when(seen == known, _turns(record, mapping).cast(TURNS)).otherwise(chosen)

    return F.transform(chosen, lambda turn: F.struct(
        F.coalesce(turn["role"], F.lit("")).alias("role"),
        F.coalesce(turn["text"], F.lit("")).alias("text")))


def escape(text: Column) -> Column:
    """Break up control strings; every backslash of the result begins a two-character escape."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(f"{control[0]}\\.{control[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|\.)", "$1")


def write(turns: Column) -> Column:
    """The turns as one string."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(
        F.lit(START), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(END))))


def loss_spans(turns: Column, trained: str = TRAINED) -> Column:
    """Where the texts to be learnt are in the written string: code points, end exclusive."""
    fixed = len(START) + len(MIDDLE) + len(END)

    def step(state: Column, turn: Column) -> Column:
        role, text = F.length(escape(turn["role"])), F.length(escape(turn["text"]))
        begin = state["at"] + len(START) + len(MIDDLE) + role
        span = F.struct(begin.cast("int").alias("start"), (begin + text).cast("int").alias("end"))
        return F.struct(
            (state["at"] + fixed + role + text).cast("int").alias("at"),
            F.when(turn["role"] == trained, F.concat(state["spans"], F.array(span)))
            .otherwise(state["spans"]).alias("spans"))

    spans = "array<struct<start:int,end:int>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans"))
    return F.aggregate(turns, empty, step)["spans"]


def parse(formatted: Column) -> Column:
    """Turns read back from a written string."""
    marked = F.filter(F.split(formatted, F.lit(r"<\|im_end\|>")), lambda x: x != "")
    return F.transform(marked, lambda x: F.struct(
        unescape(F.substring_index(F.substr(x, F.lit(len(START) + 1)), MIDDLE, 1)).alias("role"),
        unescape(F.substring_index(x, MIDDLE, -1)).alias("text")))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(
        F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))))


def format_records(records: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """conv_id, turns, formatted and loss_spans of variant records, one row per record.

    A record whose layout is unknown has null turns, a null string and null spans.
    """
    turns = records.select(F.col(key).alias("conv_id"), canonical(F.col(record)).alias("turns"))
    return turns.select(
        "conv_id", "turns", F.when(F.col("turns").isNotNull(), write(F.col("turns"))).alias("formatted"),
        loss_spans(F.col("turns")).alias("loss_spans"))


def format_rows(rows: DataFrame) -> DataFrame:
    """The same of a table with one row per turn (conv_id, turn, role, text).

    Each row is a record of its own layout; a conversation's turns are put in the order of
    turn, then role and text, nulls first; repeated rows stay. A null conv_id is a conversation.
    """
    record = F.to_variant_object(F.struct(
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    turns = (
        rows.select("conv_id", "turn", canonical(record)[0].alias("said"))
        .groupBy("conv_id")
        .agg(F.transform(
            F.array_sort(F.collect_list(F.struct(
                F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"),
                F.col("said.role").alias("role"), F.col("said.text").alias("text")))),
            lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )
    return turns.select(
        "conv_id", "turns", write(F.col("turns")).alias("formatted"),
        loss_spans(F.col("turns")).alias("loss_spans"))
