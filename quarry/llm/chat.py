"""Chat formatting with DataFrame functions only.

A declarative template names, per role, the marks around a turn and whether its text is trained on, and
the turns that may follow each other. A finite-state machine walks the roles of a conversation; its
verdict is a column, and conversations it rejects are formatted all the same. The output is the formatted
string and its segments (text, loss), whose concatenation it is.

Inside texts and roles every control string of the template is escaped: a backslash goes in after its
first character, and one more where backslashes are there already. Taking one backslash out of each such
place gives the text back, so escaping is reversible for every string.

Nulls: a null text or role counts as empty, a null turn sorts first, rows with a null conversation make
one conversation. Turns tied on their number go by role, then text. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks: ``open`` + role + ``head`` + text + ``close`` for each turn."""

    open: str = "<s>"
    head: str = "[INST]"
    body: str = "[/INST]"
    close: str = "</s>"
    #: Roles whose text is trained on.
    loss_roles: tuple[str, ...] = ("assistant",)
    #: The machine: from each state, the state that a role leads to. Other roles reject.
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "primed", "user": "asked"},
            "primed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    #: States a conversation may end in.
    final: tuple[str, ...] = ("answered", "asked")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.head, self.body, self.close)


def _pattern(t: Template, escaped: bool) -> str:
    """Control strings with any number of backslashes after the first character (one at least if
    ``escaped``), as groups: first character, backslashes to keep, rest."""
    firsts = "".join(sorted({re.escape(c[0]) for c in t.controls}))
    alternatives = "|".join(sorted({re.escape(c[1:]) for c in t.controls}, key=len, reverse=True))
    return rf"([{firsts}]){'\\\\' if escaped else ''}(\\*)({alternatives})"


def escape(c: Column, t: Template) -> Column:
    return F.regexp_replace(c, _pattern(t, False), r"$1\\$2$3")


def unescape(c: Column, t: Template) -> Column:
    return F.regexp_replace(c, _pattern(t, True), "$1$2$3")


def verdict(roles: Column, t: Template) -> Column:
    """Whether the machine accepts an array of roles."""
    moves = F.create_map(*[F.lit(x) for s, to in t.moves.items() for r, e in to.items() for x in (f"{s}\n{r}", e)])
    end = F.aggregate(roles, F.lit(t.start), lambda s, r: F.coalesce(F.element_at(moves, F.concat(s, F.lit("\n"), r)), F.lit("rejected")))
    return end.isin(*t.final)


def format_chats(turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, valid, segments array<struct<text, loss>>, formatted."""
    t = template or Template()
    said = turns.select(
        F.col(conv).alias("_conv"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_t"),
    )
    convs = said.groupBy("_conv").agg(F.array_sort(F.collect_list("_t"), _in_order).alias("_turns"))

    def parts(x: Column) -> Column:
        seg = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
        no = F.lit(False)
        mark = F.concat(F.lit(t.open), escape(x["role"], t), F.lit(t.head))
        return F.array(seg(mark, no), seg(escape(x["text"], t), x["role"].isin(*t.loss_roles)), seg(F.lit(t.body + t.close), no))

    out = convs.select(
        F.col("_conv").alias(conv),
        verdict(F.transform("_turns", lambda x: x["role"]), t).alias("valid"),
        F.flatten(F.transform("_turns", parts)).alias("segments"),
    )
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def _in_order(x: Column, y: Column) -> Column:
    """Turns by number (null first), role, text."""
    less = F.lit(0)
    for name in ("text", "role"):
        less = F.when(x[name] < y[name], -1).when(x[name] > y[name], 1).otherwise(less)
    by_turn = F.when(x["turn"].isNull() & y["turn"].isNull(), less).when(x["turn"].isNull(), -1).when(y["turn"].isNull(), 1)
    return by_turn.when(x["turn"] < y["turn"], -1).when(x["turn"] > y["turn"], 1).otherwise(less)


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted string: array<struct<role, text>>. Escaped texts hold no control
    strings, so the marks found are the template's."""
    t = template or Template()
    whole = F.substring(formatted, len(t.open) + 1, 1 << 30)
    ends = t.body + t.close
    turns = F.filter(F.split(whole, re.escape(ends + t.open) + "|" + re.escape(ends) + r"\z", -1), lambda x: F.contains(x, F.lit(t.head)))
    cut = lambda x: F.instr(x, t.head)
    return F.transform(
        turns,
        lambda x: F.struct(
            unescape(F.substring(x, F.lit(1), cut(x) - 1), t).alias("role"),
            unescape(F.substring(x, cut(x) + len(t.head), F.lit(1 << 30)), t).alias("text"),
        ),
    )


def digests(chats: DataFrame, template: Template | None = None, conv: str = "conv_id") -> DataFrame:
    """Digest columns of formatted conversations, all read back from the output."""
    t = template or Template()
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    turns = read_back(F.col("formatted"), t)
    rows = chats.withColumn("_turns", turns).withColumn(
        "_loss", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
    )
    said = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return rows.select(
        conv,
        F.size("_turns").cast("long").alias("n_turns"),
        sha(said).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        sha(F.col("_loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
