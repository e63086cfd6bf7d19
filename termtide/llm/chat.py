"""Chat formatting of records whose layouts differ.

Records are JSON texts. Their nested field paths, without the types of the
values, are hashed to a fingerprint, and the fingerprint selects a mapping from a
declarative table: which fields hold which turns. The mapping yields canonical
turns, which a template writes into one text with marked turns. Everything is an
expression of Spark SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termtide.llm.common import free_name

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
TRAINED_ROLE = "assistant"

_SCALARS = r"(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DECIMAL\(\d+,\s*\d+\)|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY)"


@dataclass(frozen=True)
class Layout:
    """How a layout gives turns.

    ``schema`` is the record's shape with ``?`` for values, as ``schema_of_variant``
    writes it. Either ``fields`` (role and the fields whose filled values, joined by a
    blank line, are one turn; a turn with no filled value is left out if optional)
    or ``items`` (list, role field, text field, new names of roles), or both.
    """

    name: str
    schema: str
    fields: tuple[tuple[str, tuple[str, ...], bool], ...] = ()
    items: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)


_HUMAN = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}

LAYOUTS = [
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content: ?, role: ?>>>", items=("messages", "role", "content")),
    Layout("no messages", "OBJECT<messages: ARRAY<?>>", items=("messages", "role", "content")),
    Layout(
        "conversations", "OBJECT<conversations: ARRAY<OBJECT<from: ?, value: ?>>>",
        items=("conversations", "from", "value"), roles=_HUMAN,
    ),
    Layout(
        "system and conversations", "OBJECT<conversations: ARRAY<OBJECT<from: ?, value: ?>>, system: ?>",
        fields=(("system", ("system",), False),), items=("conversations", "from", "value"), roles=_HUMAN,
    ),
    Layout(
        "prompt and response", "OBJECT<prompt: ?, response: ?>",
        fields=(("user", ("prompt",), False), ("assistant", ("response",), False)),
    ),
    Layout(
        "prompt and completion", "OBJECT<completion: ?, prompt: ?>",
        fields=(("user", ("prompt",), False), ("assistant", ("completion",), False)),
    ),
    Layout(
        "instruction", "OBJECT<instruction: ?, output: ?>",
        fields=(("user", ("instruction",), False), ("assistant", ("output",), False)),
    ),
    Layout(
        "instruction and input", "OBJECT<input: ?, instruction: ?, output: ?>",
        fields=(("user", ("instruction", "input"), False), ("assistant", ("output",), False)),
    ),
    Layout(
        "instruction with system", "OBJECT<input: ?, instruction: ?, output: ?, system: ?>",
        fields=(("system", ("system",), True), ("user", ("instruction", "input"), False), ("assistant", ("output",), False)),
    ),
]


def fingerprint(record: Column) -> Column:
    """A hash of the nested field paths of a variant; types of values do not count."""
    return F.xxhash64(F.regexp_replace(F.schema_of_variant(record), rf"(^|[:<] ?){_SCALARS}(?=[,>]|$)", "$1?"))


def _text(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "string"), F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _field_turns(record: Column, layout: Layout) -> list[Column]:
    parts = []
    for role, names, optional in layout.fields:
        values = [_text(record, f"$.{n}") for n in names]
        text = F.array_join(F.filter(F.array(*values), lambda v: v != ""), "\n\n") if len(values) > 1 else values[0]
        turn = F.array(_turn(F.lit(role), text))
        parts.append(F.when(text != "", turn).otherwise(F.slice(turn, 1, 0)) if optional else turn)
    return parts


def _item_turns(record: Column, layout: Layout) -> Column:
    name, role, text = layout.items
    items = F.coalesce(F.try_variant_get(record, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
    known = F.create_map(*[F.lit(x) for pair in layout.roles.items() for x in pair]) if layout.roles else None

    def turn(item: Column) -> Column:
        said = _text(item, f"$.{role}")
        return _turn(F.coalesce(known[said], said) if known is not None else said, _text(item, f"$.{text}"))

    return F.transform(items, turn)


def canonical_turns(record: Column, mark: Column, layouts: list[Layout]) -> Column:
    """The turns of a record by the mapping its fingerprint selects; null if there is none."""
    turns = F.lit(None).cast(TURNS)
    for layout in layouts:
        parts = _field_turns(record, layout)
        if layout.items:
            parts.append(_item_turns(record, layout))
        own = F.concat(*parts) if len(parts) > 1 else parts[0]
        turns = F.when(mark == F.xxhash64(F.lit(layout.schema)), own.cast(TURNS)).otherwise(turns)
    return turns


def escape(text: Column) -> Column:
    """No ``<|`` is left: a backslash more after each ``<`` with backslashes and ``|`` behind it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_chats(records: DataFrame, record: str = "record", layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """``records`` with ``fingerprint, formatted, loss_mask``.

    ``loss_mask`` has ``start`` (from 0) and ``length``, in code points of
    ``formatted``, of each text an assistant says, in order. Missing and null
    values are empty texts. A record that is null, no JSON, or of a layout without
    mapping has a null ``formatted``: none is dropped, and the fingerprint tells
    which layout lacks a mapping. No turns give an empty text. New columns replace
    those of the same names.
    """
    names = {n: free_name(records, f"_{n}") for n in ("variant", "print", "turns", "head", "body", "spans")}
    v, p, t, h, b, s = (names[n] for n in ("variant", "print", "turns", "head", "body", "spans"))
    heads = F.transform(t, lambda x: F.concat(F.lit(START), _escape_role(x["role"]), F.lit("\n")))
    bodies = F.transform(t, lambda x: escape(x["text"]))
    tail = f"{END}\n"
    texts = F.transform(F.arrays_zip(h, b), lambda x: F.concat(x[h], x[b], F.lit(tail)))
    # running place: each step appends to the list and moves on by a turn's length
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x[h])
        span = F.array(F.struct(begin.alias("start"), F.length(x[b]).alias("length")))
        trained = x[t]["role"] == TRAINED_ROLE
        return F.struct(
            (begin + F.length(x[b]) + len(tail)).alias("at"),
            F.when(trained, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    spans = F.aggregate(F.arrays_zip(t, h, b), start, step, lambda acc: acc["spans"])
    return (
        records.withColumn(v, F.try_parse_json(record))
        .withColumn(p, fingerprint(F.col(v)))
        .withColumn(t, canonical_turns(F.col(v), F.col(p), layouts))
        .withColumns({h: heads, b: bodies})
        .withColumn("formatted", F.array_join(texts, ""))
        .withColumn("loss_mask", spans)
        .withColumn("fingerprint", F.col(p))
        .drop(*names.values())
    )


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted text, as they were before escaping."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(START) + 1))
        role = F.substring_index(inner, "\n", 1)
        return _turn(_unescape_role(role), unescape(F.substr(inner, F.length(role) + 2)))

    return F.transform(F.filter(pieces, lambda x: x != ""), turn)


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, as it was before escaping, nothing between."""
    texts = F.transform(mask, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))
    return F.array_join(texts, "")
