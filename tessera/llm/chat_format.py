"""Chat formatting: heterogeneous conversation layouts to canonical turns, rendered with a reversible template.

A table's nested field paths are hashed to a schema fingerprint; the fingerprint selects a declarative mapping that
says which expressions give a row's turns. The mappings cover rows by turn, message lists in two spellings, and
prompt/response and instruction/input/output records. Rendering, the loss mask and reading back are DataFrame
functions throughout; no Python runs on the executors.

Null texts and roles are empty; null message lists and records without any text have no turns. Turns of equal
number are ordered by role, then text. Extra columns don't change a fingerprint's mapping (a layout is found by the
paths it needs). A conversation is one row in the end, so its size is bounded by a row's; its turns are rendered
before they are brought together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import table

#: Marks of this template, and control strings of public templates that texts may contain.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
FOREIGN = ("s>", "/s>", "<SYS>>", "</SYS>>", "INST]", "/INST]", "start_of_turn>", "end_of_turn>")

#: An opening character, any escapes, and what makes it the beginning of a control string.
_TAIL = "(?=" + "|".join(["\\|", *(x.replace("/", "\\/").replace("]", "\\]") for x in FOREIGN)]) + ")"
_ESCAPE = r"([<\[])(\\*)" + _TAIL
_UNESCAPE = r"([<\[])\\(\\*)" + _TAIL


def escaped(text: F.Column) -> F.Column:
    """The text with a backslash more after the opening character of every control string; reversible."""
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescaped(text: F.Column) -> F.Column:
    """The inverse of ``escaped``."""
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaves of a type, list levels as ``[]``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def schema_fingerprint(paths: list[str]) -> str:
    """SHA-256 of the sorted paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _turn(role: F.Column, text: F.Column) -> F.Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _listed(column: str, role: str, text: str, names: dict[str, str] | None = None) -> Callable[[], F.Column]:
    def turns() -> F.Column:
        def one(m: F.Column) -> F.Column:
            r = m[role]
            for old, new in (names or {}).items():
                r = F.when(m[role] == old, F.lit(new)).otherwise(r)
            return _turn(r, m[text])

        return F.coalesce(F.transform(F.col(column), one), F.array().cast("array<struct<role:string,text:string>>"))

    return turns


def _record(**roles: tuple[str, ...]) -> Callable[[], F.Column]:
    """Turns of a record's columns; columns of one role are joined by a blank line, empty ones left out."""

    def turns() -> F.Column:
        parts = [_turn(F.lit(r), F.array_join(F.filter(F.array(*[F.col(c) for c in columns]), lambda x: x.isNotNull() & (x != "")), "\n\n")) for r, columns in roles.items()]
        return F.filter(F.array(*parts), lambda t: t["text"] != "")

    return turns


@dataclass(frozen=True)
class Layout:
    """A layout's leaf paths and how its rows give turns; ``by_row`` if a row is a single turn."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[], F.Column] | None = None
    by_row: bool = False


LAYOUTS = (
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), by_row=True),
    Layout("messages", ("messages[].role", "messages[].content"), _listed("messages", "role", "content")),
    Layout("from_value", ("conversations[].from", "conversations[].value"), _listed("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    Layout("prompt_response", ("prompt", "response"), _record(user=("prompt",), assistant=("response",))),
    Layout("instruction", ("instruction", "input", "output"), _record(user=("instruction", "input"), assistant=("output",))),
    Layout("instruction_only", ("instruction", "output"), _record(user=("instruction",), assistant=("output",))),
)
BY_FINGERPRINT = {schema_fingerprint(list(x.paths)): x for x in LAYOUTS}


def layout_of(df: DataFrame) -> Layout:
    """The layout whose fingerprint is that of the table's paths, or of the largest known subset of them."""
    paths = set(field_paths(df.schema))
    if exact := BY_FINGERPRINT.get(schema_fingerprint(list(paths))):
        return exact
    known = [x for x in LAYOUTS if set(x.paths) <= paths]
    if not known:
        raise ValueError(f"no mapping for the fields {sorted(paths)}")
    return BY_FINGERPRINT[schema_fingerprint(list(max(known, key=lambda x: len(x.paths)).paths))]


def _segments(role: F.Column, text: F.Column, loss_role: str) -> F.Column:
    """A turn as strings with a loss flag: its opening, its text, its end."""
    opening = F.concat(F.lit(START), escaped(role), F.lit(SEP))
    return F.array(
        F.struct(opening.alias("text"), F.lit(False).alias("loss")),
        F.struct(escaped(text).alias("text"), (role == loss_role).alias("loss")),
        F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
    )


def format_chats(df: DataFrame, id_col: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: its id, and ``segments``, the strings that make the formatted text when joined,
    each with its loss flag. Which mapping applies follows from the table's schema fingerprint.

    ``id_col`` names the id of layouts with a conversation per row; rows by turn are grouped by ``conv_id``.
    """
    layout = layout_of(df)
    if layout.by_row:
        role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
        rendered = df.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text"), _segments(role, text, loss_role).alias("segments")).alias("one"))
        ordered = F.array_sort(F.collect_list("one"))
        return rendered.groupBy("conv_id").agg(F.flatten(F.transform(ordered, lambda t: t["segments"])).alias("segments"))
    turns = layout.turns()
    columns = [id_col] if id_col else []
    return df.select(*columns, F.flatten(F.transform(turns, lambda t: _segments(t["role"], t["text"], loss_role))).alias("segments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds what the output holds: ``formatted`` (the joined text), ``turns`` parsed from it, and ``loss_text``."""
    out = formatted.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    parts = F.filter(F.split("formatted", "<\\|im_start\\|>", -1), lambda _, i: i > 0)

    def turn(part: F.Column) -> F.Column:
        body = F.substring_index(part, END, 1)
        return F.struct(unescaped(F.substring_index(body, SEP, 1)).alias("role"), unescaped(F.substring_index(body, SEP, -1)).alias("text"))

    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return out.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", F.array_join(masked, ""))


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts look like control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    out = read_back(format_chats(rows.unionByName(own)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(role) + length(text) + 33
    + len(regexp_extract_all(role, '[<\[]\\*(\||/?s>|</?SYS>>|/?INST\]|start_of_turn>|end_of_turn>)'))
    + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|</?SYS>>|/?INST\]|start_of_turn>|end_of_turn>)')) AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
