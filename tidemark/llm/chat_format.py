r"""Chat formatting by a finite-state machine over roles and a declarative template, in DataFrame expressions only.

A :class:`Template` gives each role its opening and closing control string and whether its text bears the loss, and the
transitions between roles that a valid conversation may take. :func:`format_conversations` gathers the rows of each
conversation in turn order, runs the machine over the roles, and emits text segments with a loss flag each; their
concatenation is the formatted text. Control strings open with a lead character (``<`` or ``[``). In texts, lead
characters and the escape character are replaced (``\`` by ``\e``, ``<`` by ``\l``, ``[`` by ``\b``), so no text can
hold a control string and :func:`read_back` restores every turn exactly.

Edge cases: a null text or role counts as empty; a role that the template doesn't know is written between ``[ROLE]``
and ``[/ROLE]`` and makes the conversation invalid; equal turns are ordered by role, then text, and repeated rows are
kept; a null conv_id is one conversation; an empty table gives an empty table. Invalid conversations are formatted all
the same, with ``valid`` false. One conversation becomes one row, so its rows meet in one task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
_OTHER_OPEN, _OTHER_TEXT, _OTHER_CLOSE = "[ROLE]", "[/ROLE]", "[END]"


@dataclass(frozen=True)
class Role:
    """Control strings around a role's text, and whether the text bears the loss."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles by name; the roles that may follow each state (``""`` is the start); the states a whole dialogue may end in."""

    roles: dict[str, Role]
    follows: dict[str, tuple[str, ...]]
    ends: tuple[str, ...] = field(default=("assistant",))

    def __post_init__(self) -> None:
        if bad := [s for r in self.roles.values() for s in (r.opening, r.closing) if s[:1] not in ("<", "[")]:
            raise ValueError(f"control strings must begin with < or [: {bad}")


INSTRUCT = Template(
    roles={"system": Role("<<SYS>>", "<</SYS>>"), "user": Role("[INST]", "[/INST]"), "assistant": Role("<s>", "</s>", loss=True)},
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)


def escaped(text: Column) -> Column:
    """``text`` without any lead character of a control string."""
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """The inverse of :func:`escaped`."""
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _by_role(template: Template, role: Column, what: str, other: Column) -> Column:
    out = other
    for name, r in template.roles.items():
        out = F.when(role == name, F.lit(getattr(r, what))).otherwise(out)
    return out


def format_conversations(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Per conversation: conv_id, valid, complete, segments (array of text and loss), formatted."""
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    moves = [F.lit(f"{a}>{b}") for a, after in template.follows.items() for b in after]

    def step(state: Column, turn: Column) -> Column:
        return F.when(F.array_contains(F.array(*moves), F.concat(state, F.lit(">"), turn["role"])), turn["role"]).otherwise("!")

    def segments(turn: Column) -> Column:
        other = F.concat(F.lit(_OTHER_OPEN), escaped(turn["role"]), F.lit(_OTHER_TEXT))
        parts = (
            (_by_role(template, turn["role"], "opening", other), F.lit(False)),
            (escaped(turn["text"]), _by_role(template, turn["role"], "loss", F.lit(False))),
            (_by_role(template, turn["role"], "closing", F.lit(_OTHER_CLOSE)), F.lit(False)),
        )
        return F.array(*(F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts))

    return (
        rows.select("conv_id", "turn", "role", "text")
        .groupBy("conv_id")
        .agg(turns.alias("turns"))
        .withColumn("state", F.aggregate("turns", F.lit(""), step))
        .select(
            "conv_id",
            (F.col("state") != "!").alias("valid"),
            F.col("state").isin(*template.ends).alias("complete"),
            F.flatten(F.transform("turns", segments)).alias("segments"),
        )
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns of a formatted text: an array of role and text."""
    quote = lambda strings: "|".join(re.escape(s) for s in strings)
    known = template.roles.values()
    opening = rf"{quote(r.opening for r in known)}|{re.escape(_OTHER_OPEN)}[^<\[]*{re.escape(_OTHER_TEXT)}"
    closing = quote([*(r.closing for r in known), _OTHER_CLOSE])
    pattern = F.lit(rf"({opening})([^<\[]*)(?:{closing})")
    other = lambda head: unescaped(F.substring(head, len(_OTHER_OPEN) + 1, F.length(head) - len(_OTHER_OPEN) - len(_OTHER_TEXT)))

    def role(head: Column) -> Column:
        out = other(head)
        for name, r in template.roles.items():
            out = F.when(head == r.opening, F.lit(name)).otherwise(out)
        return out

    return F.zip_with(
        F.regexp_extract_all(formatted, pattern, F.lit(1)),
        F.regexp_extract_all(formatted, pattern, F.lit(2)),
        lambda head, text: F.struct(role(head).alias("role"), unescaped(text).alias("text")),
    )


def format_digest(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    # The text of turn i is segment 3 i + 1; its loss flag picks what is read back.
    said = F.array_join(F.transform(F.filter("turns", lambda t, i: F.get("segments", 3 * i + 1)["loss"]), lambda t: t["text"]), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        format_conversations(rows, template)
        .withColumn("turns", read_back(F.col("formatted"), template))
        .withColumn("said", said)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(turns, 256).alias("turns_sha256"),
            F.length("said").cast("long").alias("loss_chars"),
            F.sha2("said", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "valid",
            "complete",
        )
    )
