"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """``open role sep text [sep text ...] close`` for each run of turns of one role.

    ``also_escaped`` are control strings of other templates that must not reach a model from inside a text.
    """

    open: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    learned_role: str = "assistant"
    also_escaped: tuple[str, ...] = field(default=("<s>", "</s>", "[INST]", "[/INST]"))

    @property
    def control(self) -> tuple[str, ...]:
        return (self.open, self.sep, self.close, *self.also_escaped)


CHAT = Template()


def escaped(text: Column, template: Template = CHAT) -> Column:
    """Backslashes are doubled, then one is put behind the first character of every control string."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for control in template.control:
        out = F.replace(out, F.lit(control), F.lit(control[0] + ESCAPE + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside of lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(turns: Column) -> Column:
    """Array of runs: neighbouring turns of the same role, each run an array of turns."""
    def opens(i: Column) -> Column:
        return (i == 0) | ~F.get(turns, i - 1)["role"].eqNullSafe(F.get(turns, i)["role"])

    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), opens)
    return _bound(
        starts,
        lambda s: F.transform(
            s, lambda at, k: F.slice(turns, at + 1, F.coalesce(F.get(s, k + 1), F.size(turns)) - at)
        ),
    )


def _segments(run: Column, template: Template) -> Column:
    """The pieces of one run with their place under the loss mask."""
    def piece(text: Column, learned: Column) -> Column:
        return F.struct(text.alias("text"), learned.alias("loss"))

    role = F.get(run, F.lit(0))["role"]
    no = F.lit(False)
    texts = F.transform(
        run,
        lambda turn: F.array(
            piece(F.lit(template.sep), no), piece(escaped(turn["text"], template), role == template.learned_role)
        ),
    )
    head = F.array(piece(F.concat(F.lit(template.open), escaped(role, template)), no))
    return F.concat(head, F.flatten(texts), F.array(piece(F.lit(template.close), no)))


def format_chats(turns: DataFrame, template: Template = CHAT, conv_id: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``formatted`` and ``segments``, an array of (text, loss) whose texts make up ``formatted``.

    Turns are collected as structs, sorted by number (then role, then text, so ties have one order), neighbours of
    one role are merged into one run, and everything is concatenated.  Control strings inside of texts are escaped
    and come back by ``read_chats``.  Null texts and roles are empty, null numbers come first, null ids form one
    conversation, repeated rows are repeated turns.  Other columns of the input are left out.  A conversation is one
    row of the result, so its turns meet in one task; work is linear in their number.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("__turn"),
    )
    collected = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("__turn")).alias("__turns"))
    segments = _bound(
        F.col("__turns"), lambda t: F.flatten(F.transform(_runs(t), lambda run: _segments(run, template)))
    )
    return collected.select("conv_id", segments.alias("segments")).withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")
    )


def read_chats(formatted: Column, template: Template = CHAT) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    def literally(mark: str) -> str:
        return f"\\Q{mark}\\E"

    runs = F.split(formatted, literally(template.close))
    runs = F.slice(runs, 1, F.size(runs) - 1)

    def turns_of(run: Column) -> Column:
        inner = F.split(F.substring(run, len(template.open) + 1, 2**31 - 1), literally(template.sep))
        return _bound(
            inner,
            lambda parts: F.transform(
                F.slice(parts, 2, F.size(parts) - 1),
                lambda t: F.struct(unescaped(F.get(parts, F.lit(0))).alias("role"), unescaped(t).alias("text")),
            ),
        )

    return F.flatten(F.transform(runs, turns_of))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask as it was before escaping."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: unescaped(s["text"])), "")
