"""Chat formatting (native): a role automaton over turns and a declarative template with loss flags.

Every conversation becomes one string of segments.  Control strings in roles and
texts are escaped reversibly: a backslash follows each ``<``, ``[`` and backslash
of the text, so no control string of any common template can appear inside a text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ESCAPE, _ESCAPED = r"([<\[\\])", r"$1\\"
_UNESCAPE = r"([<\[\\])\\"


@dataclass(frozen=True)
class Template:
    """Marks around each turn, the roles whose text is trained on, and the turn automaton.

    ``moves`` maps a state to the state after each role; a role without a move
    leads to ``invalid``, which nothing leaves.  Marks must hold ``<`` or ``[``
    not followed by a backslash, which an escaped text never does.
    """

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, _ESCAPED)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1")


def _step(moves: dict[str, dict[str, str]], state: Column, role: Column) -> Column:
    out = F.lit("invalid")
    for name, by_role in moves.items():
        for r, to in by_role.items():
            out = F.when((state == name) & (role == r), to).otherwise(out)
    return out


def format_chats(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, valid, final_state, formatted, segments``.

    ``segments`` is an array of ``(text, loss)`` whose texts concatenate to
    ``formatted``: per turn the opening marks, the escaped text and the end mark;
    only the text of a loss role has its flag set.

    Input ``conv_id, turn, role, text``; other columns are ignored.  Turns are
    ordered by (turn, role, text), nulls first, so ties and repeated rows have a
    fixed order and each row is one turn.  A null role or text is empty; null
    ``conv_id`` is a conversation of its own.  An empty table gives no row.
    ``valid`` is true if the automaton ends outside ``invalid``; invalid
    conversations are formatted as well.  A conversation is one training record,
    so its turns are gathered into one row.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = chats.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(template.turn), escape(t["role"]), F.lit(template.text)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
        F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
    )))
    state = F.aggregate("turns", F.lit("start"), lambda s, t: _step(template.moves, s, t["role"]))
    return (grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.alias("final_state"), segments.alias("segments"))
            .select("conv_id", "n_turns", (F.col("final_state") != "invalid").alias("valid"), "final_state",
                    F.concat_ws("", F.col("segments.text")).alias("formatted"), "segments"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """The turns and the trained-on text as a reader of the output sees them.

    Adds ``turns`` (array of role, text; parsed from ``formatted`` alone) and
    ``loss_text`` (unescaped text under the loss flags, nothing between).
    """
    parts = F.slice(F.split("formatted", _quoted(template.turn)), 2, 1_000_000_000)
    turns = F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(p, template.text, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, template.text, -1), template.end, 1)).alias("text")))
    loss = F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])))
    return formatted.select("*", turns.alias("turns"), loss.alias("loss_text"))


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def digest(back: DataFrame) -> DataFrame:
    """Counts and hashes of what was read back, one row per conversation."""
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")
