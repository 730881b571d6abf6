"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record is a JSON object in one of several layouts. The fingerprint of a
record is the hash of its nested field paths; types of values do not count. Each
known layout declares its paths and where role and text of every turn stand, and the
fingerprint selects the declaration.

The template writes a turn as ``### role: text</turn>`` and a line end. Inside
roles and texts a backslash becomes ``\\b``, ``###`` becomes ``\\h`` and ``</turn>``
becomes ``\\e`` (in roles ``:`` becomes ``\\c``), so control strings stand only where the template
puts them and the formatted text can be read back exactly. The loss mask covers the
(escaped) text of assistant turns, as spans of code points.

Null texts and roles are empty. Records of an unknown layout keep a null layout
and no turns. Everything is DataFrame code; one record is one row throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, NAMED, CLOSE = "### ", ": ", "</turn>\n"
SCALARS = r": (STRING|VOID|BOOLEAN|BIGINT|DOUBLE|DECIMAL\([0-9,]+\)|VARIANT)"
TURNS = "array<struct<role:string,text:string>>"


def listing(path: str, role: str, text: str, names: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """Turns from an array of objects; ``names`` translates role names."""

    def turns(record: Column) -> Column:
        found = F.variant_get(record, f"$.{path}", f"array<struct<{role}:string,{text}:string>>")

        def turn(x: Column) -> Column:
            name = F.coalesce(x[role], F.lit(""))
            for old, new in (names or {}).items():
                name = F.when(x[role] == old, new).otherwise(name)
            return F.struct(name.alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))

        return F.transform(found, turn)

    return turns


def fields(*parts: tuple[str, tuple[str, ...]]) -> Callable[[Column], Column]:
    """Turns from fixed fields: (role, fields whose non-empty texts are joined by a blank line)."""

    def turns(record: Column) -> Column:
        made = []
        for role, paths in parts:
            texts = [F.nullif(F.variant_get(record, f"$.{p}", "string"), F.lit("")) for p in paths]
            made.append(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *texts).alias("text")))
        return F.array(*made)

    return turns


# Layout: its nested field paths as sorted by name, and its mapping.
LAYOUTS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "prompt": ("OBJECT<completion, prompt>", fields(("user", ("prompt",)), ("assistant", ("completion",)))),
    "instruction": ("OBJECT<instruction, output>", fields(("user", ("instruction",)), ("assistant", ("output",)))),
    "instruction_input": ("OBJECT<input, instruction, output>", fields(("user", ("instruction", "input")), ("assistant", ("output",)))),
    "messages": ("OBJECT<messages: ARRAY<OBJECT<content, role>>>", listing("messages", "role", "content")),
    "conversations": (
        "OBJECT<conversations: ARRAY<OBJECT<from, value>>>",
        listing("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    ),
}


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a parsed record."""
    return F.sha2(F.regexp_replace(F.schema_of_variant(record), SCALARS, ""), 256)


def canonical(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Adds ``layout`` (null if unknown) and ``turns`` to rows with a JSON record."""
    parsed = F.try_parse_json(F.col(record_col))
    rows = records.withColumn("_parsed", parsed).withColumn("_print", fingerprint(F.col("_parsed")))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, (paths, mapping) in LAYOUTS.items():
        fits = F.col("_print") == hashlib.sha256(paths.encode()).hexdigest()
        layout = F.when(fits, name).otherwise(layout)
        turns = F.when(fits, mapping(F.col("_parsed")).cast(TURNS)).otherwise(turns)
    return rows.withColumns({"layout": layout, "turns": turns}).drop("_parsed", "_print")


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for code, plain in (("\\h", "###"), ("\\e", "</turn>"), ("\\c", ":"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def render(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` (start from 0, length; code points) to rows with ``turns``."""
    head = lambda t: F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit(":"), F.lit("\\c")), F.lit(NAMED))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss")))
    rows = rows.withColumn("_parts", parts)
    formatted = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["head"])
        size = F.length(p["body"]).cast("long")
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        spans = F.when(p["loss"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((begin + size + len(CLOSE)).alias("at"), spans.alias("spans"))

    spans = F.aggregate("_parts", start, step, lambda state: state["spans"])
    return rows.withColumns({"formatted": formatted, "loss_spans": spans}).drop("_parts")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    chunks = F.split(formatted, "</turn>\n", -1)
    chunks = F.slice(chunks, F.lit(1), F.size(chunks) - 1)

    def turn(chunk: Column) -> Column:
        at = F.instr(chunk, NAMED)
        role = chunk.substr(F.lit(len(OPEN) + 1), at - 1 - len(OPEN))
        return F.struct(unescape(role).alias("role"), unescape(chunk.substr(at + len(NAMED), F.length(chunk))).alias("text"))

    return F.transform(chunks, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    texts = F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(texts, "")
