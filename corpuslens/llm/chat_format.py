"""Conversations of any known layout as one training text with a loss mask.

A record is a JSON object. The paths of its fields, lists as ``[]``, are its
schema; a fingerprint is the hash of paths. A mapping names the paths that it
needs, and its fingerprint is theirs; a record has the layout if the paths it
shares with the mapping have that fingerprint, so ids, names and other fields
beside them don't count. Of several mappings that fit, the one that needs the most
paths is taken, the earlier one at a tie. New layouts are added as mappings, not
as code; what a schema selects is looked up once for each schema. Canonical
turns are written with control strings around them; control strings within roles
and texts, those of other common templates too, get a backslash after their
first character, which reading takes away again.

Defined cases: null texts and roles are empty; a conversation without turns has
no row; turns of equal number are ordered by role, then text; records of an
unknown layout give a row with ``layout`` null and no turns (``layout_counts``
counts them); a list of no turns is a layout without turns; a text that is a list of parts is
their texts, one after another; an empty table gives no rows; a null conv_id is an
id like another; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template.
TURN, SAY, END = "<|turn|>", "<|say|>", "<|end|>"
#: What may follow the first character of a control string, here or in other common templates.
_REST = r"\||/?s>|/?INST\]|/?SYS>>|/?think>"
TRAINED_ROLE = "assistant"
TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Mapping:
    """``turns``: the list of turns and the fields of a turn; or ``fields``: (role, field names joined by a blank line) one after another."""

    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    order: str | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
#: The known layouts.
MAPPINGS = (
    Mapping("rows", ("rows[].role", "rows[].text", "rows[].turn"), turns="rows", text="text", order="turn"),
    Mapping("messages", ("messages[].content", "messages[].role"), turns="messages"),
    Mapping("shared", ("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", roles=_NAMES),
    Mapping("prompt", ("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", ("input", "instruction", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("system_prompt", ("prompt", "response", "system"), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question", ("answer", "question"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


def field_paths(value, at: str = "") -> set[str]:
    """The nested field paths of a parsed record, those of objects and lists included."""
    if isinstance(value, dict):
        return set().union({at} - {""}, *(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union({at, f"{at}[]"}, *(field_paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


class Registry:
    """Mappings by the fingerprint of the paths they need, the most paths first."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.known = [(fingerprint(m.paths), frozenset(m.paths), m) for m in sorted(mappings, key=lambda m: -len(m.paths))]
        self.seen: dict[str, Mapping | None] = {}

    def select(self, record: dict) -> Mapping | None:
        paths = field_paths(record)
        schema = fingerprint(paths)
        if schema not in self.seen:
            if len(self.seen) > 10_000:
                self.seen = {}
            empty = [m for _, _, m in self.known if m.turns and record.get(m.turns) == []]
            self.seen[schema] = next((m for mark, need, m in self.known if fingerprint(need & paths) == mark), empty[0] if empty else None)
        return self.seen[schema]


def canonical(record, mapping: Mapping) -> list[dict[str, str]]:
    """The turns of a record that has the mapping's layout."""
    def text(x) -> str:
        if isinstance(x, list) and all(isinstance(p, str) or (isinstance(p, dict) and isinstance(p.get("text"), str)) for p in x):
            return "".join(p if isinstance(p, str) else p["text"] for p in x)
        return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)

    if mapping.turns is None:
        return [{"role": role, "text": "\n\n".join(t for t in (text(record.get(n)) for n in names) if t)} for role, names in mapping.fields]
    turns = [t for t in record[mapping.turns] if isinstance(t, dict)]
    if mapping.order:
        turns = sorted(turns, key=lambda t: (t.get(mapping.order) is not None, t.get(mapping.order) or 0, text(t.get(mapping.role)), text(t.get(mapping.text))))
    names = dict(mapping.roles)
    return [{"role": names.get(r := text(t.get(mapping.role)), r), "text": text(t.get(mapping.text))} for t in turns]


def to_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS, id_column: str = "conv_id", record_column: str = "record") -> DataFrame:
    """``(conv_id, layout, turns)`` of JSON records."""
    rows = records.select(records[id_column].alias("__id"), records[record_column].alias("__record"))

    def run(batches):
        known = Registry(mappings)
        for b in batches:
            layouts, turns = [], []
            for raw in b.column("__record").to_pylist():
                try:
                    record = json.loads(raw) if raw else None
                except ValueError:
                    record = None
                m = known.select(record) if isinstance(record, dict) else None
                layouts.append(m.name if m else None)
                turns.append(canonical(record, m) if m else [])
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(layouts, pa.string()), pa.array(turns, kind)], ["__id", "layout", "turns"])

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, layout string, turns {TURNS}").withColumnRenamed("__id", id_column)


def layout_counts(turns: DataFrame) -> DataFrame:
    """``(layout, n)`` of ``to_turns``' rows; a null layout counts the records of which none is known."""
    return turns.groupBy("layout").agg(F.count("*").alias("n"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_REST})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={_REST})", "$1$2")


def formatted(turns: Column) -> Column:
    """The training text of canonical turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(SAY), escape(t["text"]), F.lit(END))), "")


def loss_spans(turns: Column, trained: str = TRAINED_ROLE) -> Column:
    """Spans (code points) of ``formatted(turns)`` that the loss covers: the trained role's texts, without control strings."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + F.length(escape(t["role"])) + len(TURN) + len(SAY)
        end = begin + F.length(escape(t["text"]))
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(t["role"] == trained, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def read_back(text: Column) -> Column:
    """The turns of a training text."""
    parts = F.filter(F.split(text, r"<\|end\|>"), lambda p: p != "")
    half = lambda p, i: unescape(F.element_at(F.split(p, r"<\|say\|>"), i))
    return F.transform(parts, lambda p: F.struct(half(F.substring(p, len(TURN) + 1, 1 << 30), 1).alias("role"), half(p, 2).alias("text")))


def format_records(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS, trained: str = TRAINED_ROLE) -> DataFrame:
    """``(conv_id, layout, formatted, loss)`` of ``records(conv_id, record)``."""
    turns = to_turns(records, mappings)
    return turns.select("conv_id", "layout", formatted(F.col("turns")).alias("formatted"), loss_spans(F.col("turns"), trained).alias("loss"))


def records_from_rows(rows: DataFrame) -> DataFrame:
    """Gathers ``rows(conv_id, turn, role, text)`` into records of the layout "rows"; the turns of one conversation end up in one value."""
    turn = F.struct(F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.collect_list(turn).alias("rows")).select("conv_id", F.to_json(F.struct("rows")).alias("record"))


def records_of_layouts(rows: DataFrame) -> DataFrame:
    """``(conv_id, record)``: ``rows(conv_id, turn, role, text)`` gathered into records of all nine layouts, each conversation in one.

    Which one goes by conv_id; a conversation that its layout can't hold as it is (other
    roles or numbers of turns, names that a mapping would change, a text without the
    blank line that parts it) becomes messages. Turns are in the order of the layout
    "rows". The turns of one conversation end up in one value.
    """
    turn = F.struct(F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    said = lambda i: F.get("turns", F.lit(i))["text"]
    pair, three = roles == F.array(F.lit("user"), F.lit("assistant")), roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    parts = F.split(said(0), "\n\n", 2)
    record = lambda **fields: F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    listed = lambda role, text: F.transform("turns", lambda t: F.struct(t["role"].alias(role), t["text"].alias(text)))
    layouts = (
        (F.lit(True), record(rows=F.col("turns"))),
        (F.lit(False), F.lit(None).cast("string")),
        (~F.arrays_overlap(roles, F.array(*[F.lit(n) for n, _ in _NAMES])), record(conversations=listed("from", "value"), id=F.col("conv_id"))),
        (pair, record(prompt=said(0), completion=said(1))),
        (pair, record(prompt=said(0), response=said(1))),
        (pair, record(instruction=said(0), output=said(1), meta=F.struct(F.lit("x").alias("source")))),
        (pair & (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != ""), record(instruction=F.get(parts, F.lit(0)), input=F.get(parts, F.lit(1)), output=said(1))),
        (three, record(system=said(0), prompt=said(1), response=said(2))),
        (pair, record(question=said(0), answer=said(1))),
    )
    messages = record(messages=listed("role", "content"))
    turn_of = F.pmod(F.coalesce("conv_id", F.lit(1)), F.lit(len(layouts)))
    chosen = functools.reduce(lambda c, x: c.when((turn_of == x[0]) & F.coalesce(x[1][0], F.lit(False)), x[1][1]), enumerate(layouts), F.when(F.lit(False), messages))
    return got.select("conv_id", chosen.otherwise(messages).alias("record"))
