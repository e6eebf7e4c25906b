"""Chat formatting: layouts of conversations are recognised by their schema and mapped to canonical turns.

The nested field paths of a record are hashed to a fingerprint, which selects a declarative mapping; the mapping makes
canonical turns (role, text), which a template turns into one training text with its loss mask, reversibly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: Role whose texts are under the loss mask.
LEARNED = "assistant"


def fingerprint(paths: set[str]) -> str:
    """16 hex digits of the set of nested field paths, whatever their order; elements of a list have the path `[]`."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def paths_of_schema(kind: T.DataType, at: str = "") -> set[str]:
    """Field paths of a Spark type. Names in lower case, as Spark takes them."""
    if isinstance(kind, T.StructType):
        return set().union(*(paths_of_schema(f.dataType, f"{at}.{f.name.lower()}" if at else f.name.lower()) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return paths_of_schema(kind.elementType, f"{at}[]")
    return {at}


def paths_of_record(value: object, at: str = "") -> set[str]:
    """Field paths of a parsed JSON value; an empty list or null counts as a leaf."""
    if isinstance(value, dict) and value:
        return set().union(*(paths_of_record(v, f"{at}.{k.lower()}" if at else k.lower()) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(paths_of_record(v, f"{at}[]") for v in value))
    return {at}


@dataclass(frozen=True)
class Mapping:
    """How a layout gives turns. fields: (path, role) in the order of the turns, of layouts with one field to a turn.
    Or list: path of a list of messages, with the paths of role and text in each. Or row: the columns of a table that
    has one turn to a row."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    list: str = ""
    role: str = ""
    text: str = ""
    row: tuple[str, str, str, str] | None = None  # conversation, turn, role, text
    rename: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

    def paths(self) -> set[str]:
        if self.row:
            return set(self.row)
        return {f"{self.list}[].{self.role}", f"{self.list}[].{self.text}"} if self.list else {p for p, _ in self.fields}

    def turns(self, record: dict) -> list[tuple[str, str]]:
        """Canonical turns of a record; fields that are null or empty give none, null texts in a list are empty."""
        if self.list:
            found = [(m.get(self.role), m.get(self.text)) for m in _at(record, self.list) or []]
        else:
            found = [(role, text) for path, role in self.fields if (text := _at(record, path))]
        names = dict(self.rename)
        return [(names.get(r or "", r or ""), t or "") for r, t in found]


def _at(record: object, path: str) -> object:
    for name in path.split("."):
        record = next((v for k, v in record.items() if k.lower() == name), None) if isinstance(record, dict) else None
    return record


MAPPINGS = (
    Mapping("turn rows", row=("conv_id", "turn", "role", "text"), rename=()),
    Mapping("messages", list="messages", role="role", text="content"),
    Mapping("conversations", list="conversations", role="from", text="value"),
    Mapping("instruction", fields=(("instruction", "user"), ("output", "assistant"))),
    Mapping("instruction and input", fields=(("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Mapping("prompt and completion", fields=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("prompt and response", fields=(("prompt", "user"), ("response", "assistant"))),
    Mapping("system, question and answer", fields=(("system", "system"), ("question", "user"), ("answer", "assistant"))),
    Mapping("nested data", fields=(("data.prompt", "user"), ("data.response", "assistant"))),
)


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    return {fingerprint(m.paths()): m for m in mappings}


def _fitting(paths: set[str], mappings: tuple[Mapping, ...], empty: frozenset[str] = frozenset()) -> Mapping | None:
    """The mapping with just these paths, by its fingerprint; else that of the most paths that are all there, or whose
    list is there without a message (empty: paths of empty lists); the first of equals."""
    if found := registry(mappings).get(fingerprint(paths)):
        return found
    fits = [m for m in mappings if m.paths() <= paths or m.list and m.list in empty]
    return max(fits, key=lambda m: len(m.paths()), default=None)


def mapping_of(schema: T.StructType, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping:
    """The mapping of a table. If no layout has just its paths, that of the most paths that are all there, so that extra
    columns don't matter; KeyError if there is none."""
    paths = paths_of_schema(schema)
    if found := _fitting(paths, mappings):
        return found
    raise KeyError(f"no mapping for the fields {sorted(paths)}")


def mapping_of_record(record: object, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    """As mapping_of, of a parsed JSON object; an empty list of messages is a conversation without turns."""
    if not isinstance(record, dict):
        return None
    empty = frozenset(m.list for m in mappings if m.list and _at(record, m.list) == [])
    return _fitting(paths_of_record(record), tuple(m for m in mappings if not m.row), empty)


def canonical(records: DataFrame, id_col: str, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Records of any layout as JSON text to turn rows: (conv_id, turn, role, text, layout).

    A record with more fields than a layout's is taken by the layout of the most paths that are all there (see
    mapping_of). One that fits none, or that isn't a JSON object, gives one row with a null turn, role and layout and the
    record as its text, so that nothing is lost; a null record likewise. A conversation without turns gives one row with
    its layout and null turn, role and text.
    """

    def convert(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for key, text in zip(pdf["conv_id"], pdf["record"], strict=True):
                try:
                    record = json.loads(text) if text else None
                except ValueError:
                    record = None
                m = mapping_of_record(record, mappings)
                turns = [(key, i, r, t, m.name) for i, (r, t) in enumerate(m.turns(record))] if m else [(key, None, None, text, None)]
                rows += turns or [(key, None, None, None, m.name)]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "layout"]).astype({"turn": "Int32"})

    kind = records.schema[id_col].dataType.simpleString()
    return records.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("record")).mapInPandas(convert, f"conv_id {kind}, turn int, role string, text string, layout string")


def turn_rows(table: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, turn, role, text) of a table whose schema has a mapping of turn rows; null texts and roles are empty."""
    mapping = mapping_of(table.schema, mappings)
    row = mapping.row
    if not row:
        raise KeyError("the table has no turn rows; see canonical()")
    role = F.coalesce(F.col(row[2]), F.lit(""))
    for old, new in mapping.rename:
        role = F.when(F.col(row[2]) == old, new).otherwise(role)
    return table.select(F.col(row[0]).alias("conv_id"), F.col(row[1]).alias("turn"), role.alias("role"), F.coalesce(F.col(row[3]), F.lit("")).alias("text"))


def formatted(turns: DataFrame) -> DataFrame:
    """Adds `segment` and the loss mask (`loss_from`, `loss_to`, in code points of the segment; equal if nothing is
    learned) to turn rows. The segments of a conversation, in order of turn, make its text.

    A segment is <|im_start|>role, a line feed, the text, <|im_end|> and a line feed. In texts and roles a `<` followed
    by backslashes and `|` gets one backslash more, so that no control string is left in them; in roles, line feeds and
    backslashes are escaped before.
    """
    guard = lambda c: F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")
    role = F.replace(F.replace(F.col("role"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    head, body = F.concat(F.lit(START), guard(role), F.lit("\n")), guard(F.col("text"))
    begin = F.length(head)
    return turns.select(
        "*",
        F.concat(head, body, F.lit(END + "\n")).alias("segment"),
        begin.alias("loss_from"),
        F.when(F.col("role") == LEARNED, begin + F.length(body)).otherwise(begin).alias("loss_to"),
    )


_UNGUARD = re.compile(r"<(\\*)\\\|")


def unguard(text: str) -> str:
    return _UNGUARD.sub(r"<\1|", text)


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    head, _, body = segment.removeprefix(START).removesuffix(END + "\n").partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unguard(head))
    return role, unguard(body)


def read_back(segments: DataFrame) -> DataFrame:
    """For each conv_id: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the formatted text.

    Turns go by turn (nulls first), then by role and text, so repeated rows and ties have one order. A conversation's
    digests take its segments one after another, in one task, which keeps a few numbers and no texts.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()
    rows = segments.select("conv_id", "turn", "role", "text", "segment", "loss_from", "loss_to")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def digest(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, started = None, None, False
        row = lambda: (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for pdf in pdfs:
            out = []
            for conv, segment, a, b in zip(pdf["conv_id"].astype(object), pdf["segment"], pdf["loss_from"], pdf["loss_to"], strict=True):
                conv = None if pd.isna(conv) else conv
                if not started or conv != key:
                    if started:
                        out.append(row())
                    key, state, started = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                role, text = parse(segment)
                learned = unguard(segment[a:b])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(learned)
                state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
            yield pd.DataFrame(out, columns=names)
        if started:
            yield pd.DataFrame([row()], columns=names)

    return rows.mapInPandas(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
