"""Chat formatting with loss flags, with DataFrame functions only.

A template is data: for each role the opening and closing mark and whether its text counts for
the loss; other roles use a generic mark that carries the escaped role name.  A finite-state
machine, also data, says which role may follow which.  A conversation becomes an array of
segments (text, loss) whose texts joined are the formatted text; ``read_back`` parses that text
into turns again.

Escaping.  Control strings start with ``[`` or ``<`` and hold neither of them after that.  Inside
a text, ``[INST]`` becomes ``[\\INST]``: one more backslash behind the first character, and the
same where backslashes stand there already, so it can be undone exactly and all other texts stay
as they are.  No control string can then occur inside a text.

Scale.  One shuffle on the conversation, each conversation built in one row, since its formatted
text is one value.  Memory is bounded by the longest conversation.

Defined results.  Null text is empty, null role is the role ``""``; turns sort by turn (null
first), role, text; rows of a null conversation id form one conversation; an order of roles that
the machine rejects gives ``valid`` false and is formatted all the same.  An empty table gives an
empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks and the loss flag by role, and the marks of roles that are not listed."""

    turns: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("[SYS] ", " [/SYS]", False),
            "user": ("[INST] ", " [/INST]", False),
            "assistant": ("[OUT] ", "</s>", True),
        }
    )
    other: tuple[str, str, str] = ("[ROLE] ", " [TEXT] ", " [/ROLE]")

    @property
    def controls(self) -> list[str]:
        marks = [m.strip() for a, b, _ in self.turns.values() for m in (a, b)] + [m.strip() for m in self.other]
        return list(dict.fromkeys(marks))

    @property
    def tails(self) -> str:
        """Alternation of what stands behind the first character of each control string."""
        return "|".join(re.escape(c[1:]) for c in sorted(self.controls, key=len, reverse=True))


#: state -> {role: next state}; a role that is missing leads to "bad".
TURN_ORDER: dict[str, dict[str, str]] = {
    "start": {"system": "told", "user": "asked"},
    "told": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
ACCEPTING = ("asked", "answered")


def escape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, rf"([\[<])(\\*)({template.tails})", r"$1\\$2$3")


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\(\\*)({template.tails})", "$1$2$3")


def final_state(roles: Column, order: dict[str, dict[str, str]] = TURN_ORDER) -> Column:
    """Runs the machine over an array of roles."""

    def step(state: Column, role: Column) -> Column:
        out = F.lit("bad")
        for name, edges in order.items():
            inner = F.lit("bad")
            for label, to in edges.items():
                inner = F.when(role == label, F.lit(to)).otherwise(inner)
            out = F.when(state == name, inner).otherwise(out)
        return out

    return F.aggregate(roles, F.lit("start"), step)


def segments(turn: Column, template: Template) -> Column:
    """The segments of one turn: opening mark, text, closing mark."""

    def seg(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    body = escape(turn["text"], template)
    a, b, c = template.other
    out = F.array(seg(F.concat(F.lit(a), escape(turn["role"], template), F.lit(b)), False), seg(body, False), seg(F.lit(c), False))
    for role, (head, tail, loss) in template.turns.items():
        out = F.when(turn["role"] == role, F.array(seg(F.lit(head), False), seg(body, loss), seg(F.lit(tail), False))).otherwise(out)
    return out


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, segments, formatted, state, valid."""
    template = template or Template()
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return (
        talks.withColumn("segments", F.flatten(F.transform("turns", lambda t: segments(t, template))))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .withColumn("state", final_state(F.transform("turns", lambda t: t["role"])))
        .withColumn("valid", F.col("state").isin(*ACCEPTING))
        .select("conv_id", "segments", "formatted", "state", "valid")
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """Formatted text -> array of (role, text), as they went in."""
    template = template or Template()
    a, b, c = (re.escape(x) for x in template.other)
    known = "|".join(rf"(?:{re.escape(h)})(?:.*?)(?:{re.escape(t)})" for h, t, _ in template.turns.values())
    turns = F.regexp_extract_all(formatted, F.lit(rf"(?s)(?:{known}|{a}.*?{b}.*?{c})"), F.lit(0))

    def parse(x: Column) -> Column:
        inner = F.substr(x, F.lit(len(template.other[0]) + 1), F.length(x) - len(template.other[0]) - len(template.other[2]))
        at = F.instr(inner, template.other[1])
        out = F.struct(
            unescape(F.substr(inner, F.lit(1), at - 1), template).alias("role"),
            unescape(F.substr(inner, at + len(template.other[1])), template).alias("text"),
        )
        for role, (head, tail, _) in template.turns.items():
            body = F.substr(x, F.lit(len(head) + 1), F.length(x) - len(head) - len(tail))
            out = F.when(x.startswith(head), F.struct(F.lit(role).alias("role"), unescape(body, template).alias("text"))).otherwise(out)
        return out

    return F.transform(turns, parse)


def digest(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """What the query returns of each formatted conversation, read back from the output."""
    template = template or Template()
    trained = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template))
    return (
        chats.withColumn("back", read_back(F.col("formatted"), template))
        .withColumn("loss_text", F.array_join(trained, ""))
        .select(
            "conv_id",
            F.size("back").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
            F.length("loss_text").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "valid",
        )
    )
