"""Chat formatting with DataFrame functions alone.

A finite-state machine over roles checks the turn order, and a declarative
template turns each conversation into text segments with a loss flag each. In
the texts, control strings are escaped reversibly: a ``<`` and ``|`` with k
backslashes between them get k + 1, so the marks of the template never occur
inside a text; reading back removes one.

Defined cases: turns are ordered by turn, role, text, nulls first, so repeated
rows keep their place; a null text is empty; a null or unknown role leaves the
machine in its error state, and the conversation is formatted all the same with
``valid`` false; a null conversation id is a conversation; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around each turn, which roles are learned, and which role may follow which."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: State "" is the start; a state is the last role.
    transitions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)})
    final: tuple[str, ...] = ("assistant",)


ERROR = "!"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    doubled = F.replace(unescape(role), F.lit("\\\\"), F.lit("\0"))
    return F.replace(F.replace(doubled, F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\"))


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, state, valid, segments, formatted): segments are (text, loss) in order."""
    t = template
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, follow in t.transitions.items() for b in follow])
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    step = lambda state, x: F.when(F.array_contains(allowed, F.concat(state, F.lit(">"), F.coalesce(x["role"], F.lit(ERROR)))), x["role"]).otherwise(F.lit(ERROR))
    state = F.aggregate("turns", F.lit(""), step)
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = F.transform(
        "turns",
        lambda x: F.array(
            segment(F.concat(F.lit(t.open), _escape_role(F.coalesce(x["role"], F.lit(""))), F.lit(t.after_role)), F.lit(False)),
            segment(escape(x["text"]), F.coalesce(x["role"].isin(*t.loss_roles), F.lit(False))),
            segment(F.lit(t.close + t.after_turn), F.lit(False)),
        ),
    )
    return gathered.select("conv_id", state.alias("state"), F.flatten(parts).alias("segments")).select(
        "conv_id", "state", F.col("state").isin(*t.final).alias("valid"), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted")
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turns) from the formatted text alone: the roles and texts that went in."""
    t = template
    parts = F.split("formatted", f"\\Q{t.open}\\E", -1)
    blocks = F.slice(parts, F.lit(2), F.size(parts))  # nothing stands before the first mark
    tail = len(t.close + t.after_turn)

    def turn(block: Column) -> Column:
        body = F.substr(block, F.lit(1), F.length(block) - tail)
        role_end = F.locate(t.after_role, body)
        role, text = F.substr(body, F.lit(1), role_end - 1), F.substr(body, role_end + len(t.after_role))
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    return formatted.select("*", F.transform(blocks, turn).alias("turns_read"))


def loss_text(segments: Column | str = "segments") -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
