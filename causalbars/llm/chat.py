"""Chat formatting by schema fingerprints: DataFrame functions only, no Python on the executors.

Conversations arrive in many layouts (turn rows, message arrays, prompt and completion, instruction and output).
A layout is recognised by its fingerprint, a hash of the nested field paths that carry chat data; fields outside
``KNOWN_FIELDS`` are ignored, so extra columns do not matter. The fingerprint selects a declarative mapping to
canonical turns ``(conv_id, turn, role, text)``. Typed tables are fingerprinted by schema, JSON records row by
row, so one table may mix layouts.

The template writes each turn as ``### <role>: <text> </turn>`` and a line feed. In texts ``\\``, ``#`` and ``<``
get a backslash, in roles anything special is percent-encoded, so neither marker can occur inside a turn and
reading back is exact.

Defined results: a null text or role counts as empty; turns with equal numbers are ordered by role and text, null
numbers come first; repeated rows are repeated turns; rows without a conversation id form one conversation;
unknown layouts give no turns (``layout`` says "unknown"); an empty table gives an empty table. A conversation's
digest needs its whole text in one row, so a conversation, unlike a table, must fit in a task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, SEPARATOR, CLOSE = "### ", ": ", " </turn>\n"


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    Either ``array`` holds one element a turn, with its role and text in two fields, or ``fixed`` lists
    (role, fields) in order, where the non-empty fields of a turn are joined by a blank line.
    """

    name: str
    array: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> list[str]:
        if self.array:
            name, role, text = self.array
            return [f"{name}[].{role}", f"{name}[].{text}"]
        return [f for _, fields in self.fixed for f in fields]


MAPPINGS = (
    Mapping("messages", ("messages", "role", "content")),
    Mapping("messages_text", ("messages", "role", "text")),
    Mapping("conversations", ("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Mapping("prompt_completion", fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("system_prompt_response", fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction_output", fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input_output", fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question_answer", fixed=(("user", ("question",)), ("assistant", ("answer",)))),
)
#: The layout of a table with one row a turn.
TURN_ROWS = ["role", "text", "turn"]
KNOWN_FIELDS = sorted({p.split("[]")[0] for m in MAPPINGS for p in m.paths()} | set(TURN_ROWS))
_ELEMENT_FIELDS = sorted({p.split("[].")[1] for m in MAPPINGS for p in m.paths() if "[]." in p})


def fingerprint(paths: list[str]) -> str:
    """The hash that names a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


_BY_PRINT = {fingerprint(m.paths()): m for m in MAPPINGS}
_ROWS_PRINT = fingerprint(TURN_ROWS)


def schema_paths(schema: T.StructType) -> list[str]:
    """Nested field paths of the known fields of a typed table."""
    paths = []
    for own in schema:
        if own.name in KNOWN_FIELDS:
            kind = own.dataType
            if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
                paths += [f"{own.name}[].{f.name}" for f in kind.elementType if f.name in _ELEMENT_FIELDS]
            else:
                paths.append(own.name)
    return paths


def _turns(mapping: Mapping, get) -> Column:
    """array<struct<turn, role, text>> by a mapping; ``get`` gives the column of a top-level field."""

    def role_of(x: Column) -> Column:
        named = x
        for theirs, ours in mapping.roles.items():
            named = F.when(x == theirs, F.lit(ours)).otherwise(named)
        return named

    if mapping.array:
        name, role, text = mapping.array
        return F.transform(get(name), lambda m, i: F.struct(i.cast("long").alias("turn"), role_of(m[role]).cast("string").alias("role"), m[text].cast("string").alias("text")))
    made = []
    for i, (role, names) in enumerate(mapping.fixed):
        parts = F.filter(F.array(*[get(n).cast("string") for n in names]), lambda x: F.coalesce(x, F.lit("")) != "")
        made.append(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.array_join(parts, "\n\n").alias("text")))
    return F.array(*made)


def canonical_turns(table: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turn rows (conv_id, turn, role, text) of a typed table, by its schema's fingerprint."""
    own = fingerprint(schema_paths(table.schema))
    key = F.col(f"`{id_col}`").alias("conv_id")
    if own == _ROWS_PRINT:
        return table.select(key, F.col("turn").cast("long").alias("turn"), "role", "text")
    if own not in _BY_PRINT:
        raise ValueError(f"no mapping for the layout {sorted(schema_paths(table.schema))}")
    turns = F.explode(_turns(_BY_PRINT[own], lambda name: F.col(f"`{name}`"))).alias("t")
    return table.select(key, turns).select("conv_id", "t.turn", "t.role", "t.text")


def json_turns(table: DataFrame, json_col: str = "record", id_col: str = "conv_id") -> DataFrame:
    """(conv_id, layout, turns) of JSON records of mixed layouts, each mapped by its own fingerprint."""
    record = F.col(f"`{json_col}`")

    def known(keys: Column, names: list[str]) -> Column:
        return F.array_intersect(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, names)))

    def below(k: Column) -> Column:
        inner = F.call_function("get_json_object", record, F.concat(F.lit("$."), k, F.lit("[0]")))
        found = known(F.json_object_keys(inner), _ELEMENT_FIELDS)
        return F.when(F.size(found) > 0, F.transform(found, lambda f: F.concat(k, F.lit("[]."), f))).otherwise(F.array(k))

    paths = F.flatten(F.transform(known(F.json_object_keys(record), KNOWN_FIELDS), below))
    printed = F.sha2(F.array_join(F.array_sort(paths), "\n"), 256)
    element = "array<struct<" + ", ".join(f"`{f}`: string" for f in _ELEMENT_FIELDS) + ">>"
    arrays = {m.array[0] for m in MAPPINGS if m.array}
    ddl = ", ".join(f"`{f}` {element if f in arrays else 'string'}" for f in KNOWN_FIELDS)
    parsed = table.select(F.col(f"`{id_col}`").alias("conv_id"), printed.alias("print"), F.from_json(record, ddl).alias("r"))
    layout, turns = F.lit("unknown"), F.lit(None).cast("array<struct<turn: bigint, role: string, text: string>>")
    for own, mapping in _BY_PRINT.items():
        layout = F.when(F.col("print") == own, F.lit(mapping.name)).otherwise(layout)
        turns = F.when(F.col("print") == own, _turns(mapping, lambda name: F.col("r")[name])).otherwise(turns)
    return parsed.select("conv_id", layout.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    for special in ("\\", "#", "<"):
        text = F.replace(text, F.lit(special), F.lit("\\" + special))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame) -> DataFrame:
    """One row a conversation: formatted text and loss_spans (start, end of assistant texts in it): the loss mask."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head, body = F.concat(F.lit(OPEN), F.url_encode(role), F.lit(SEPARATOR)), escape(text)
    pieces = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), body.alias("body")).select(
        "conv_id",
        F.row_number().over(order).alias("at"),
        F.concat("head", "body", F.lit(CLOSE)).alias("piece"),
        (F.col("role") == "assistant").alias("loss"),
        F.char_length("head").alias("skip"),
        F.char_length("body").alias("size"),
        F.sum(F.char_length("head") + F.char_length("body") + len(CLOSE)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
    )
    listed = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "loss", "size", "end"))).alias("p"))

    def span(x: Column) -> Column:
        stop = x["end"] - len(CLOSE)
        return F.struct((stop - x["size"]).alias("start"), stop.alias("end"))

    return listed.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("p", lambda x: x["loss"]), span).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text recovered from formatted texts and their loss mask."""
    marks = F.split("formatted", r"\Q" + CLOSE + r"\E", -1)
    segments = F.slice(marks, 1, F.size(marks) - 1)

    def parse(s: Column) -> Column:
        role = F.substring_index(F.substr(s, F.lit(len(OPEN) + 1)), SEPARATOR, 1)
        rest = F.substr(s, F.instr(s, SEPARATOR) + len(SEPARATOR))
        return F.struct(F.url_decode(role).alias("role"), unescape(rest).alias("text"))

    under = F.transform("loss_spans", lambda x: unescape(F.substring("formatted", x["start"] + 1, x["end"] - x["start"])))
    return formatted.select("conv_id", "formatted", F.transform(segments, parse).alias("turns"), F.array_join(under, "").alias("loss_text"))


def digests(formatted: DataFrame) -> DataFrame:
    """What :func:`read_back` recovers, as counts and digests."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
