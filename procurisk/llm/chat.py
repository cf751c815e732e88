"""Chat formatting by a finite-state machine over roles, from a declarative template, with DataFrame functions only.

A template says which label opens the turns of a role, what closes a turn, which roles may follow which, and whose texts carry
loss. A conversation becomes segments (text, loss flag, start) whose texts, put together, are the formatted conversation; the
machine walks over its roles and reports the first turn that is out of order. Control strings inside texts and role names are
written with an escape character, so that a formatted conversation can be read back exactly (``read_back``).

Rows are ordered by turn, null first, then role and text. A null role or text is empty. A role without a label keeps its name,
escaped, as its label. Rows with a null conv_id are one conversation with a null id. Repeated rows are turns of their own. Other
columns are ignored; an empty table gives no rows. Turns out of order are formatted too, with ``valid`` false.

Formatting, escaping and offsets are worked out row by row before a conversation's rows meet. A conversation is one row of the
result, so it must fit into a row; no other bound applies.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

START = "start"


@dataclass(frozen=True)
class Template:
    """How turns are marked. ``moves`` maps (state, role) to the next state; a missing pair is out of order."""

    labels: Mapping[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    opening: str = "### "
    after_label: str = ": "
    close: str = "</turn>\n"
    #: what must not stand in a text as it is; inside labels ``after_label`` is added
    controls: tuple[str, ...] = ("### ", "</turn>")
    escape: str = "\\"
    other_label: str = "@"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: Mapping[tuple[str, str], str] = field(
        default_factory=lambda: {
            (START, "system"): "system",
            (START, "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    accepting: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for control in (*self.controls, self.after_label):
            if not control or self.escape in control or re.search(r"\d", control):
                raise ValueError(f"a control string holds the escape character or a digit: {control!r}")
        if not any(control in self.close for control in self.controls):
            raise ValueError("no control string stands in the closing one, so a text could hold it")
        if any(self.close.startswith(self.close[i:]) for i in range(1, len(self.close))):
            raise ValueError("the closing string must not begin as it ends")
        for label in self.labels.values():
            if label.startswith(self.other_label) or self.after_label in label or self.close in label:
                raise ValueError(f"a label that cannot be read back: {label!r}")


TEMPLATE = Template()


def escaped(text: Column, template: Template, label: bool = False) -> Column:
    """The text with the escape character as escape + 0 and the control strings as escape + their number."""
    marks = (*template.controls, template.after_label) if label else template.controls
    text = F.replace(text, F.lit(template.escape), F.lit(f"{template.escape}0"))
    for number, mark in enumerate(marks, 1):
        text = F.replace(text, F.lit(mark), F.lit(f"{template.escape}{number}"))
    return text


def unescaped(text: Column, template: Template) -> Column:
    """What ``escaped`` was given: an escape character only ever stands before a number, so the order is free but for 0."""
    for number, mark in enumerate((*template.controls, template.after_label), 1):
        text = F.replace(text, F.lit(f"{template.escape}{number}"), F.lit(mark))
    return F.replace(text, F.lit(f"{template.escape}0"), F.lit(template.escape))


def _label(role: Column, template: Template) -> Column:
    named = F.concat(F.lit(template.other_label), escaped(role, template, label=True))
    for known, label in template.labels.items():
        named = F.when(role == known, F.lit(label)).otherwise(named)
    return named


def _role(label: Column, template: Template) -> Column:
    role = unescaped(F.substr(label, F.lit(len(template.other_label) + 1)), template)
    for known, written in template.labels.items():
        role = F.when(label == written, F.lit(known)).otherwise(role)
    return role


def walk(roles: Column, template: Template) -> Column:
    """The machine over an array of roles: its last ``state``, and the number of the first turn out of order in ``invalid_turn``."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    begin = F.struct(F.lit(START).alias("state"), F.lit(0).alias("turn"), F.lit(None).cast("int").alias("invalid_turn"))

    def step(at: Column, role: Column) -> Column:
        state = F.coalesce(moves[F.concat(at["state"], F.lit("\n"), role)], F.lit("out of order"))
        turn = at["turn"] + 1
        wrong = F.coalesce(at["invalid_turn"], F.when(state == "out of order", turn))
        return F.struct(state.alias("state"), turn.alias("turn"), wrong.alias("invalid_turn"))

    return F.aggregate(roles, begin, step)


def format_conversations(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, valid, invalid_turn, segments (text, loss, start in code points) and formatted, a row per conversation.

    ``valid`` is true if every turn was in order and the last state is an accepting one. ``invalid_turn`` (from 1) is null where
    every turn was in order.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).select(
        "conv_id",
        "role",
        F.row_number().over(order).alias("turn_no"),
        F.concat(F.lit(template.opening), _label(F.col("role"), template), F.lit(template.after_label)).alias("opening"),
        escaped(F.col("text"), template).alias("body"),
    )
    chars = F.length("opening") + F.length("body") + len(template.close)
    before = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("start", F.coalesce(F.sum(chars.cast("long")).over(before), F.lit(0)))
    grouped = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn_no", "start", "role", "opening", "body"))).alias("turns")
    )

    def segments(turn: Column) -> Column:
        body_at = turn["start"] + F.length(turn["opening"])
        parts = (
            (turn["opening"], F.lit(False), turn["start"]),
            (turn["body"], turn["role"].isin(*template.loss_roles), body_at),
            (F.lit(template.close), F.lit(False), body_at + F.length(turn["body"])),
        )
        return F.array(*[F.struct(a.alias("text"), b.alias("loss"), c.alias("start")) for a, b, c in parts])

    machine = walk(F.transform("turns", lambda turn: turn["role"]), template).alias("machine")
    return (
        grouped.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), F.size("turns").alias("n"), machine)
        .select(
            "conv_id",
            F.col("n").cast("long").alias("n_turns"),
            (F.isnull("machine.invalid_turn") & F.col("machine.state").isin(*template.accepting)).alias("valid"),
            F.col("machine.invalid_turn").cast("long").alias("invalid_turn"),
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        )
    )


def read_back(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    pieces = F.split(formatted, rf"\Q{template.close}\E")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, template.after_label, 1)
        label = F.substr(head, F.lit(len(template.opening) + 1))
        text = F.substr(piece, F.length(head) + len(template.after_label) + 1)
        return F.struct(_role(label, template).alias("role"), unescaped(text, template).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def loss_text(segments: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: unescaped(s["text"], template)), "")


def digests(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Numbers and digests of what is read back from formatted conversations."""
    read = formatted.select(
        "conv_id",
        "valid",
        "invalid_turn",
        "formatted",
        read_back(F.col("formatted"), template).alias("turns"),
        loss_text(F.col("segments"), template).alias("learned"),
    )
    written = F.transform("turns", lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(written, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "invalid_turn",
    )
