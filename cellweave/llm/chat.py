"""Chat formatting by a declarative template: a state machine over roles, text segments and loss flags.

All steps are DataFrame functions. Turns of a conversation follow ``turn`` (ties by role, then text; a null turn comes
first); repeated rows are turns of their own. A null text is empty, a null role is the empty role, rows with a null conv_id
form one conversation, other columns are ignored. Roles the template doesn't name are written with their name; the
machine reports such a conversation as not valid, its text is formatted all the same.

Inside texts and role names every control string gets a backslash after its first character, one more for
each that is there already, so unescaping is exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Markers start with ``<`` or ``[``; no marker's remainder holds either. Text stands between blanks."""

    roles: dict[str, Role] = field(default_factory=lambda: {
        "system": Role("[SYS]", "[/SYS]"), "user": Role("[INST]", "[/INST]"), "assistant": Role("<s>", "</s>", loss=True)})
    other: Role = Role("[ROLE]", "[/ROLE]")
    text: str = "[TEXT]"
    start: str = "start"
    steps: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    accept: tuple[str, ...] = ("asked", "answered")

    def controls(self) -> list[str]:
        return [m for r in (*self.roles.values(), self.other) for m in (r.open, r.close)] + [self.text]


PLAIN = Template()


def _control(template: Template, first: str, slash: str) -> str:
    """Pattern of the control strings that begin with ``first``, with any backslashes after it."""
    rest = [re.escape(c[1:]) for c in template.controls() if c[0] == first]
    return f"({re.escape(first)}){slash}(\\\\*)(?=(?:{'|'.join(rest) or '(?!)'}))"


def escape(text: Column, template: Template = PLAIN) -> Column:
    for first in "<[":
        text = F.regexp_replace(text, _control(template, first, ""), r"$1\\$2")
    return text


def unescape(text: Column, template: Template = PLAIN) -> Column:
    for first in "<[":
        text = F.regexp_replace(text, _control(template, first, r"\\"), "$1$2")
    return text


def valid_order(roles: Column, template: Template = PLAIN) -> Column:
    """True if the machine accepts the roles in this order."""
    steps = F.create_map(*[F.lit(x) for (state, role), to in template.steps.items() for x in (f"{state}>{role}", to)])
    step = lambda state, role: F.coalesce(F.element_at(steps, F.concat(state, F.lit(">"), role)), F.lit("error"))
    return F.aggregate(roles, F.lit(template.start), step, lambda state: state.isin(*template.accept))


def format_conversations(rows: DataFrame, template: Template = PLAIN) -> DataFrame:
    """``(conv_id, formatted, segments, valid)`` from rows ``(conv_id, turn, role, text)``.

    ``segments`` holds ``(start, length, loss)`` of every piece of ``formatted`` in code points: the marker before a text,
    the text, the marker after it. ``valid`` says whether the machine accepts the order of roles.
    """
    role = F.coalesce("role", F.lit(""))
    chosen = lambda part: F.coalesce(
        *[F.when(role == name, F.lit(getattr(r, part))) for name, r in template.roles.items()], F.lit(getattr(template.other, part)))
    named = role.isin(*template.roles)
    lead = F.when(named, F.concat(chosen("open"), F.lit(" "))).otherwise(
        F.concat(F.lit(template.other.open + " "), escape(role, template), F.lit(f" {template.text} ")))
    turns = rows.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("raw"),
                        lead.alias("lead"), F.concat(F.lit(" "), chosen("close")).alias("tail"), chosen("loss").alias("loss"))
    turns = turns.withColumn("text", escape(F.col("raw"), template))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "raw")
    before = F.coalesce(F.sum(F.length("lead") + F.length("text") + F.length("tail")).over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = turns.select("conv_id", F.row_number().over(order).alias("n"), before.alias("at"), "role", "lead", "text", "tail", "loss")
    grouped = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "at", "role", "lead", "text", "tail", "loss"))).alias("t"))
    piece = lambda at, text, loss: F.struct(at.cast("long").alias("start"), F.length(text).cast("long").alias("length"), loss.alias("loss"))
    segments = F.flatten(F.transform("t", lambda x: F.array(
        piece(x["at"], x["lead"], F.lit(False)),
        piece(x["at"] + F.length(x["lead"]), x["text"], x["loss"]),
        piece(x["at"] + F.length(x["lead"]) + F.length(x["text"]), x["tail"], F.lit(False)))))
    return grouped.select(
        "conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["lead"], x["text"], x["tail"])), "").alias("formatted"),
        segments.alias("segments"), valid_order(F.transform("t", lambda x: x["role"]), template).alias("valid"))


def read_turns(formatted: Column, template: Template = PLAIN) -> Column:
    """The turns ``array<(role, text)>`` of a formatted conversation."""
    q = re.escape
    marked = [f"{q(r.open)} .*? {q(r.close)}" for r in (*template.roles.values(), template.other)]
    found = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(marked)), F.lit(0))

    def turn(x: Column) -> Column:
        inner = lambda r: x.substr(F.lit(len(r.open) + 2), F.length(x) - len(r.open) - len(r.close) - 2)
        out = lambda role, text: F.struct(role.alias("role"), unescape(text, template).alias("text"))
        rest = inner(template.other)
        cut = F.instr(rest, f" {template.text} ")
        value = out(unescape(rest.substr(F.lit(1), cut - 1), template),
                    rest.substr(cut + len(template.text) + 2, F.length(rest)))
        for name, r in template.roles.items():
            value = F.when(x.startswith(r.open + " "), out(F.lit(name), inner(r))).otherwise(value)
        return value

    return F.transform(found, turn)


def read_loss(formatted: Column, segments: Column, template: Template = PLAIN) -> Column:
    """All text under the loss mask, unescaped, in order and with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(
        formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")), template)), "")


def read_back(formatted: DataFrame, template: Template = PLAIN) -> DataFrame:
    """Counts and digests of what a formatted conversation says, read from its text and segments alone."""
    read = formatted.select("conv_id", "formatted", "valid", read_turns(F.col("formatted"), template).alias("t"),
                            read_loss(F.col("formatted"), F.col("segments"), template).alias("loss"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")
