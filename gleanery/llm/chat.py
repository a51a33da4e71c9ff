"""Chat formatting: schema fingerprints pick declarative mappings to canonical turns; one template marks the turns.

A record's fingerprint is the hash of its sorted nested field paths, types left out. Each mapping names the
fingerprint's paths it covers and where roles and texts lie, so a new layout is a new entry, not new code.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURN = "struct<turn: bigint, role: string, text: string>"


@dataclass(frozen=True)
class Mapping:
    """``shape`` lists the field paths in the order Spark writes them. Either ``turns`` names an array of records with
    a ``role`` and a ``text`` field, or ``fields`` pairs roles with top-level fields, in turn order. ``turn``: the
    field that holds a row's place in its conversation, for layouts with one row per turn."""

    name: str
    shape: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    turn: str | None = None


# Role names of common layouts and the canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

MAPPINGS: tuple[Mapping, ...] = (
    Mapping("turn rows", "OBJECT<role, text, turn>", text="text", turn="turn"),
    Mapping("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", turns="messages"),
    Mapping("from and value", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", turns="conversations", role="from", text="value"),
    Mapping("prompt and completion", "OBJECT<completion, prompt>", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt and response", "OBJECT<prompt, response>", fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", "OBJECT<instruction, output>", fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping(
        "instruction with input",
        "OBJECT<input, instruction, output>",
        fields=(("system", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
)


def field_paths(record: Column) -> Column:
    """Nested field paths of a variant, sorted, without the leaves' types."""
    return F.regexp_replace(F.schema_of_variant(record), r": (?!OBJECT|ARRAY)[A-Z]+(\([0-9, ]+\))?", "")


def fingerprint(record: Column) -> Column:
    """Hash of :func:`field_paths`; null for a null record."""
    return F.sha2(field_paths(record), 256)


def _turn(role: str, text: str):
    return lambda x, i: F.struct(i.cast("long").alias("turn"), x[role].alias("role"), x[text].alias("text"))


def canonical_turns(records: DataFrame, record: str, mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """Adds ``layout`` and ``turns`` (array of turn, role, text) to each record, a variant column.

    Records whose fingerprint no mapping has get null for both and stay. A null text is empty, a null role too.
    """
    v, none = F.col(record), F.lit(None)
    layout, turns = none.cast("string"), none.cast(f"array<{TURN}>")
    seen = fingerprint(v)
    for m in reversed(mappings):
        if m.turns:
            part = f"array<struct<`{m.role}`: string, `{m.text}`: string>>"
            got = F.transform(F.try_variant_get(v, f"$.{m.turns}", part), _turn(m.role, m.text))
        elif m.fields:
            got = F.array(
                *[
                    F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.try_variant_get(v, f"$.{f}", "string").alias("text"))
                    for i, (r, f) in enumerate(m.fields)
                ]
            )
        else:
            parts = [F.try_variant_get(v, f"$.{f}", t) for f, t in ((m.turn, "long"), (m.role, "string"), (m.text, "string"))]
            got = F.array(F.struct(*[p.alias(n) for p, n in zip(parts, ("turn", "role", "text"), strict=True)]))
        mine = seen == F.sha2(F.lit(m.shape), 256)
        layout, turns = F.when(mine, F.lit(m.name)).otherwise(layout), F.when(mine, got).otherwise(turns)
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    clean = F.transform(
        turns,
        lambda t: F.struct(
            t["turn"].alias("turn"),
            F.coalesce(names[t["role"]], t["role"], F.lit("")).alias("role"),
            F.coalesce(t["text"], F.lit("")).alias("text"),
        ),
    )
    return records.withColumns({"layout": layout, "turns": clean})


def escape(text: Column) -> Column:
    """Adds a backslash to every ``<|``, ``<\\|``, ... so that no control string is left; see :func:`unescape`."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chat(turns: DataFrame, trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """``(conv_id, formatted, loss)`` from rows ``(conv_id, turn, role, text)``: one output row per conversation.

    ``loss`` holds the mask's spans ``(start, chars)`` in code points of ``formatted``: the texts of trained roles,
    without markers. Turns are ordered by turn (null first), role and text; repeated rows are repeated turns. A null
    text or role is empty; a null ``conv_id`` is a conversation. An empty table gives no rows; other columns are ignored.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    t = t.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
    piece = F.concat("head", "body", F.lit(END + "\n"))
    upto = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("piece", piece).withColumn("stop", F.sum(F.length("piece")).over(upto))
    start = F.col("stop") - F.length("piece") + F.length("head")
    span = F.when(F.col("role").isin(*trained), F.struct(start.alias("start"), F.length("body").alias("chars")))
    parts = F.sort_array(F.collect_list(F.struct("stop", "piece")))
    out = t.groupBy("conv_id").agg(parts.alias("parts"), F.sort_array(F.collect_list(span)).alias("loss"))
    return out.select("conv_id", F.array_join("parts.piece", "").alias("formatted"), "loss")


def read_chat(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turns, masked, formatted_chars)`` read back from :func:`format_chat`'s output alone: the turns as
    (role, text), and the unescaped text under the loss mask."""
    f = F.col("formatted")
    pieces = F.filter(F.split(f, r"<\|im_end\|>\n"), lambda p: p != "")
    pieces = F.transform(pieces, lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text"),
        ),
    )
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substring(f, (s["start"] + 1).cast("int"), s["chars"]))), "")
    return formatted.select("conv_id", turns.alias("turns"), masked.alias("masked"), F.length(f).cast("long").alias("formatted_chars"))
