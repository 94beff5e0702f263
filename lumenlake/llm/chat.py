"""Conversations of many layouts as text with marked turns, and back.

Records come as prompts with answers, instructions with inputs, or lists of messages under various names.  The nested
field paths of a record, hashed, are its fingerprint, and a fingerprint selects a layout: a plain description of
where the roles and texts of its turns stand.  A table has one fingerprint, that of its schema, and its layout becomes
column expressions; JSON records have one each.  The turns go into one template, whose control strings are escaped
in texts; offsets of the answers are the loss mask.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import bound_batches, fresh_path, tidy

# ---- layouts


@dataclass(frozen=True)
class Messages:
    """A list of turns, or with an empty path a record that is one turn.  `roles` renames roles."""

    each: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=dict)

    def path_sets(self) -> list[list[str]]:
        full = [self.each + "." * bool(self.each) + p for p in (self.role, self.text)]
        return [full, [self.each]] if self.each else [full]


@dataclass(frozen=True)
class Fields:
    """A turn for each of (role, paths): the texts at the paths, with an empty line between.  Fields that are
    `optional` may be missing; a turn of such fields alone is left out if all are missing or empty."""

    turns: tuple[tuple[str, tuple[str, ...]], ...]
    optional: tuple[str, ...] = ()

    def path_sets(self) -> list[list[str]]:
        needed = [p for _, paths in self.turns for p in paths if p not in self.optional]
        return [[*needed, *more] for n in range(len(self.optional) + 1) for more in combinations(self.optional, n)]


_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_SYSTEM = ("system", ("system",))

LAYOUTS: dict[str, Messages | Fields] = {
    "turn": Messages("", "role", "text"),
    "turn-content": Messages("", "role", "content"),
    "messages": Messages("messages[]", "role", "content"),
    "messages-parts": Messages("messages[]", "role", "content[].text"),
    "conversations": Messages("conversations[]", "from", "value", _SPEAKERS),
    "prompt-completion": Fields((_SYSTEM, ("user", ("prompt",)), ("assistant", ("completion",))), ("system",)),
    "prompt-response": Fields((_SYSTEM, ("user", ("prompt",)), ("assistant", ("response",))), ("system",)),
    "instruction-output": Fields((_SYSTEM, ("user", ("instruction", "input")), ("assistant", ("output",))), ("system", "input")),
    "instruction-response": Fields((_SYSTEM, ("user", ("instruction", "context")), ("assistant", ("response",))), ("system", "context")),
    "question-answer": Fields((_SYSTEM, ("user", ("question",)), ("assistant", ("answer",))), ("system",)),
}


def fingerprint(paths) -> int:
    """A 63-bit hash of a set of nested field paths."""
    return int.from_bytes(hashlib.blake2b("\n".join(sorted(set(paths))).encode(), digest_size=8).digest(), "big") >> 1


class Registry:
    """Layouts by fingerprint.  Only paths that some layout has are hashed, so that ids, dates and other
    fields of a record do not hide its layout."""

    def __init__(self, layouts: dict[str, Messages | Fields] | None = None):
        self.layouts = LAYOUTS if layouts is None else layouts
        sets = [(name, paths) for name, layout in self.layouts.items() for paths in layout.path_sets()]
        self.known = {p for _, paths in sets for p in paths}
        self.names: dict[int, str] = {}
        for name, paths in sets:
            if self.names.setdefault(fingerprint(paths), name) != name and len(paths) > 1:  # an empty list has no turns in either
                raise ValueError(f"layouts {name} and {self.names[fingerprint(paths)]} have the same paths")

    def find(self, paths) -> tuple[int, str | None]:
        found = fingerprint(p for p in paths if p in self.known)
        return found, self.names.get(found)


def value_paths(value) -> set[str]:
    """The nested field paths of a JSON value: a.b for fields, a[] for elements."""
    found, left = set(), [("", value)]
    while left:
        at, v = left.pop()
        if isinstance(v, dict) and v:
            left += [(f"{at}.{k}" if at else k, x) for k, x in v.items()]
        elif isinstance(v, list):
            left += [(f"{at}[]", x) for x in v]
            if not v:
                found.add(f"{at}[]")
        elif at:
            found.add(at)
    return found


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a schema, as value_paths() names them."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _at(value, path: str):
    """What stands at a path, or nothing; the texts of all elements, joined, behind []."""
    for k, name in enumerate(path.split(".")):
        value = value.get(name.removesuffix("[]")) if isinstance(value, dict) else None
        if name.endswith("[]"):
            rest = ".".join(path.split(".")[k + 1 :])
            return "".join(_text(_at(x, rest)) for x in value or []) if rest else value
    return value


def _turns_of(record, layout: Messages | Fields) -> Iterator[tuple[str, str]]:
    if isinstance(layout, Messages):
        for x in (_at(record, layout.each) or []) if layout.each else [record]:
            role = _text(_at(x, layout.role))
            yield layout.roles.get(role, role), _text(_at(x, layout.text))
        return
    for role, paths in layout.turns:
        parts = [_text(_at(record, p)) for p in paths]
        if any(p not in layout.optional for p in paths) or any(parts):
            yield role, "\n\n".join(x for p, x in zip(paths, parts) if x or p not in layout.optional)


_TURN = "turn bigint, role string, text string, layout string"


def json_turns(records: DataFrame, key: str = "conv_id", column: str = "record", registry: Registry | None = None) -> DataFrame:
    """(key, turn, role, text, layout) of JSON records, one conversation each, turns counted from 0.

    A record that is no JSON object or has an unknown fingerprint gives one row whose turn and layout are null and
    whose text is the record, so that none is lost.  A null record is such a one.  Other columns are left out."""
    registry, kind = registry or Registry(), records.schema[key].dataType.simpleString()
    bound_batches(records.sparkSession)

    @tidy
    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, raw in enumerate(b.column(1).to_pylist()):
                try:
                    value = json.loads(raw) if raw else None
                except (ValueError, RecursionError):
                    value = None
                name = registry.find(value_paths(value))[1] if isinstance(value, dict) else None
                each = [(k, *t, name) for k, t in enumerate(_turns_of(value, registry.layouts[name]))] if name else [(None, None, raw, None)]
                at += [i] * len(each)
                rows += each
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], [key, "turn", "role", "text", "layout"])

    return records.select(key, column).mapInArrow(turns, f"`{key}` {kind}, {_TURN}")


def _column(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def _element(x: Column, path: str) -> Column:
    head, _, rest = path.partition("[].")
    for name in head.split("."):
        x = x[name]
    return F.array_join(F.transform(x, lambda part: F.coalesce(_element(part, rest).cast("string"), F.lit(""))), "") if rest else x.cast("string")


def table_turns(df: DataFrame, key: str = "conv_id", order: str | None = None, registry: Registry | None = None) -> DataFrame:
    """(key, turn, role, text, layout) of a table, whose schema selects the layout; `order` numbers the turns of a
    table of single turns.  Columns but these two are the record."""
    registry = registry or Registry()
    rest = T.StructType([f for f in df.schema if f.name not in (key, order)])
    found, name = registry.find(schema_paths(rest))
    if name is None:
        raise ValueError(f"no layout has the fingerprint {found:016x} of {rest.simpleString()}")
    layout, empty = registry.layouts[name], F.lit("")
    if isinstance(layout, Messages):
        renamed = F.create_map(*[F.lit(x) for pair in layout.roles.items() for x in pair]) if layout.roles else None

        def turn(role: Column, text: Column) -> Column:
            role = F.coalesce(role.cast("string"), empty)
            return F.struct((F.coalesce(F.try_element_at(renamed, role), role) if layout.roles else role).alias("role"), F.coalesce(text, empty).alias("text"))

        if not layout.each:
            one = turn(_column(layout.role), _column(layout.text).cast("string"))
            return df.select(key, (F.col(order) if order else F.lit(0)).cast("long").alias("turn"), one["role"].alias("role"), one["text"].alias("text"), F.lit(name).alias("layout"))
        turns = F.transform(_column(layout.each.removesuffix("[]")), lambda x: turn(_element(x, layout.role), _element(x, layout.text)))
    else:
        have = set(schema_paths(rest))
        each = []
        for role, paths in layout.turns:
            parts = [F.coalesce(_column(p).cast("string"), empty) if p in have else empty for p in paths]
            kept = [F.when(part != "", part) if p in layout.optional else part for p, part in zip(paths, parts)]
            one = F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *kept).alias("text"))
            only = all(p in layout.optional for p in paths)
            each.append(F.when(F.concat(*parts) != "", one) if only else one)
        turns = F.filter(F.array(*each), lambda x: x.isNotNull())
    rows = df.select(key, F.posexplode(turns).alias("turn", "__one"))
    return rows.select(key, F.col("turn").cast("long").alias("turn"), "__one.role", "__one.text", F.lit(name).alias("layout"))


# ---- the template

# What begins a conversation, and what stands before and behind the turns of each role.
BEGIN = "<s>"
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
ROLE, ROLE_END, END = "<<ROLE>>", "<</ROLE>>\n", "\n<<END>>\n"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<<END>>"]
#: The role whose texts are learned from.
LEARNED = "assistant"
#: Code points from which a row of output ends with the turn; a longer conversation has several rows.
CHUNK = 1 << 20

_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
_PLAIN, _ESCAPED = re.compile(rf"([<\[])(\\*)({_REST})"), re.compile(rf"([<\[])\\(\\*)({_REST})")


def escape(text: str) -> str:
    """text with a backslash more behind the first character of each control string, and of each that has some."""
    return _PLAIN.sub(r"\1\\\2\3", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text) if "<" in text or "[" in text else text


def _marks(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (f"{ROLE}{escape(role)}{ROLE_END}", END)


def parse(text: str) -> Iterator[tuple[str, str]]:
    """The (role, text) of the turns of a formatted text, or of a part that ends with a turn."""
    at = len(BEGIN) if text.startswith(BEGIN) else 0
    while at < len(text):
        if text.startswith(ROLE, at):
            end = text.index(ROLE_END, at)
            role, at, close = unescape(text[at + len(ROLE) : end]), end + len(ROLE_END), END
        else:
            role = next(r for r, (opening, _) in MARKS.items() if text.startswith(opening, at))
            at, close = at + len(MARKS[role][0]), MARKS[role][1]
        end = text.index(close, at)
        yield role, unescape(text[at:end])
        at = end + len(close)


_FORMATTED = "chunk int, more boolean, n_turns bigint, text string, loss array<struct<start: bigint, stop: bigint>>"
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def formatted(turns: DataFrame, key: str = "conv_id", chunk: int = CHUNK) -> DataFrame:
    """(key, chunk, more, n_turns, text, loss): the conversations of (key, turn, role, text) as marked text.

    loss has the code points [start, stop) of the row's text that are learned from: the answers, escaped, without
    their marks.  A conversation of more than `chunk` code points goes on in further rows, as `more` tells; its text is
    theirs, one after the other.  Turns of equal number, and null ones first, go by role and text; null texts and
    roles are empty, and a null key is a conversation of its own.  Rows of no known layout are left out.

    One shuffle brings the turns of a conversation together, in order; a task holds one chunk at a time, so that a
    conversation of any length is bounded in memory, though one task writes it."""
    kind = turns.schema[key].dataType.simpleString()
    known = turns.where("layout is not null") if "layout" in turns.columns else turns
    rows = known.select(key, "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.repartition(key).sortWithinPartitions(key, "turn", "role", "text").select(key, "role", "text")
    bound_batches(turns.sparkSession)

    @tidy
    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, done, held = None, [], 0
        now: list | None = None  # key, chunk, pieces, code points, loss, turns

        def closed(more: bool) -> None:
            nonlocal held
            done.append((now[0], now[1], more, now[5], "".join(now[2]), [{"start": a, "stop": b} for a, b in now[4]]))
            held += now[3]

        def batch() -> pa.RecordBatch:
            nonlocal held
            types = [schema.field(0).type, pa.int32(), pa.bool_(), pa.int64(), pa.string(), _LOSS]
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], [key, "chunk", "more", "n_turns", "text", "loss"])
            done.clear()
            held = 0
            return out

        for b in batches:
            schema = b.schema
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or conv != now[0]:
                    if now is not None:
                        closed(False)
                    now = [conv, 0, [BEGIN], len(BEGIN), [], 0]
                elif now[3] >= chunk:
                    closed(True)
                    now = [conv, now[1] + 1, [], 0, [], 0]
                (opening, close), body = _marks(role), escape(text)
                if role == LEARNED:
                    now[4].append((now[3] + len(opening), now[3] + len(opening) + len(body)))
                now[2] += [opening, body, close]
                now[3] += len(opening) + len(body) + len(close)
                now[5] += 1
                if held > CHUNK:
                    yield batch()
        if now is not None:
            closed(False)
        if done:
            yield batch()

    return rows.mapInArrow(render, f"`{key}` {kind}, {_FORMATTED}")


def write(turns: DataFrame, path: str | None = None, key: str = "conv_id", chunk: int = CHUNK) -> str:
    """Write formatted() as Parquet and return the folder, one in the shared folder if none is given."""
    path = path or fresh_path(turns.sparkSession, "chat")
    formatted(turns, key, chunk).write.option("compression", "zstd").parquet(path)
    return path


def read_back(written: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what write() wrote, from its texts
    and masks alone.

    turns_sha256 digests role, \\n, text, \\n of each turn that the text parses into; loss_chars and loss_sha256 are of
    the unescaped text under the mask.  Conversations of one row are read where they are; only the rows of longer ones
    are shuffled, and digested one after the other."""
    kind = written.schema[key].dataType.simpleString()

    @tidy
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            done = []
            for conv, more, text, loss in zip(*(c.to_pylist() for c in b.columns)):
                now = now or [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for part in (unescape(text[x["start"] : x["stop"]]) for x in loss):
                    now[3] += len(part)
                    now[4].update(part.encode())
                now[5] += len(text)
                if not more:
                    done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
                    now = None
            types = [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def digested(rows: DataFrame) -> DataFrame:
        return rows.select(key, "more", "text", "loss").mapInArrow(digest, f"`{key}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")

    bound_batches(written.sparkSession)
    whole = (F.col("chunk") == 0) & ~F.col("more")
    parts = written.where(~whole).repartition(key).sortWithinPartitions(key, "chunk")
    return digested(written.where(whole)).unionByName(digested(parts))


def format_and_read(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    return read_back(turns.sparkSession.read.parquet(write(turns, key=key)), key)


#: The conversation that op13 adds to its table, as a record of another layout.
PROBE = json.dumps({"prompt": "</s>[INST] ok [/INST]", "completion": "</s>[INST] ok [/INST]"})


def oracle(table: str = "conversations") -> str:
    """The digest of what format_and_read() gives for a table of single turns and the probe, in DuckDB's SQL."""
    probe = "'</s>[INST] ok [/INST]'"
    control = "([<\\[])(\\\\*)(" + _REST.replace("'", "''") + ")"
    length = f"length(regexp_replace({{}}, '{control}', '\\1\\\\\\2\\3', 'g'))"
    marks = " ".join(f"WHEN role = '{r}' THEN {len(a) + len(b)}" for r, (a, b) in MARKS.items())
    other = f"{len(ROLE) + len(ROLE_END) + len(END)} + {length.format('role')}"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {table}
  UNION ALL SELECT -1, 0, 'user', {probe} UNION ALL SELECT -1, 1, 'assistant', {probe})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
  CAST({len(BEGIN)} + sum({length.format('text')} + CASE {marks} ELSE {other} END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
