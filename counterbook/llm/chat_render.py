r"""Operator 10: chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string; nothing is known of its markup. Each
successive prefix of a conversation is rendered and compared with the one before: what a
turn adds after the common beginning is that turn's span, and a template
whose longer rendering does not begin with the shorter one rewrites history, which is reported,
with the first turn that shows it, instead of spans that would be wrong. A
turn's text is found inside its span by rendering the turn twice more with marker texts.

Scale. Conversations are gathered by id, one conversation in one task (it is one training
record), and rendered as pieces stream. Rendering every prefix costs the square of the turns for any black box; templates
that declare ``window`` (a turn's rendering depends on the turns since the last ``window`` ones only and on whether it is first) are rendered on
that window, and the joined pieces are compared once with the rendering of the whole conversation; if they differ every prefix is rendered after all.

Defined results: a null text is empty, a null role is the role ``""``; turns are ordered by number, then role, then text, nulls first, so
repeated turn numbers have one order; a conversation without an assistant has no loss; rows with a null conversation id are one
conversation; extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import os.path
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import type_of

#: Control strings of the template below; inside texts and roles they are escaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
ESCAPE = "\\"
_TO_ESCAPE = re.compile(r"(\\|<(?=/?s>)|\[(?=/?(?:INST|ROLE)\]))")  # a backslash, or the first character of a control string
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """A backslash after each backslash and after the first character of each control string, so none is left in the text."""
    return _TO_ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


Turn = tuple[str, str]


def instruction_template(turns: list[Turn]) -> str:
    """User turns between [INST] and [/INST], assistant turns up to </s>, any other role named between [ROLE] and [/ROLE]."""
    out = ["<s>"]
    for role, text in turns:
        if role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f" {escape(text)}</s>")
        else:
            out.append(f"[ROLE]{escape(role)}[/ROLE]{escape(text)}</s>")
    return "".join(out)


instruction_template.window = 1  # a turn's rendering depends on no other turn


class RewritesHistory(ValueError):
    """The rendering of a longer prefix does not begin with that of the shorter one."""

    def __init__(self, turn: int):
        super().__init__(f"the template changes what it rendered before turn {turn}")
        self.turn = turn


def common(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


def rendered_pieces(turns: list[Turn], template: Callable[[list[Turn]], str], window: int | None = None) -> Iterator[str]:
    """What the empty conversation renders to, then what each turn adds, rendered with the last ``window`` turns only where one is given. Raises RewritesHistory."""
    before = template([])
    yield before
    for k in range(len(turns)):
        lo = max(0, k - window) if window is not None else 0
        if window is not None:
            before = template(turns[lo:k])
        now = template(turns[lo : k + 1])
        if not now.startswith(before):
            raise RewritesHistory(k)
        yield now[len(before) :]
        before = now


def text_range(turns: list[Turn], k: int, piece: str, template) -> tuple[int, int]:
    """Where the escaped text stands in turn k's piece: two renderings that differ in the text only show how much markup stands before and after it."""
    window = getattr(template, "window", None)
    lo = max(0, k - window) if window is not None else 0
    ahead = len(template(turns[lo:k]))
    one, two = (template([*turns[lo:k], (turns[k][0], mark)])[ahead:] for mark in ("a", "b"))
    head = common(one, two)
    tail = common(one[::-1], two[::-1])
    return head, len(piece) - tail


@dataclass
class Formatted:
    text: str
    spans: list[tuple[int, int]]  # of whole turns
    texts: list[tuple[int, int]]  # of the escaped texts inside them


def format_chat(turns: list[Turn], template=instruction_template) -> Formatted:
    """The conversation's rendering and where its turns stand. What a declared window gives is compared with the whole rendering once; where they differ, the declaration is not trusted."""
    at, parts, spans, texts = 0, [], [], []
    pieces = list(rendered_pieces(turns, template, getattr(template, "window", None)))
    if "".join(pieces) != template(turns):
        pieces = list(rendered_pieces(turns, template))
    for k, piece in enumerate(pieces):
        parts.append(piece)
        if k:
            spans.append((at, at + len(piece)))
            a, b = text_range(turns, k - 1, piece, template)
            texts.append((at + a, at + b))
        at += len(piece)
    return Formatted("".join(parts), spans, texts)


OUT = "formatted string, rewrites_at int, roles array<string>, spans array<struct<start:int,stop:int,text_start:int,text_stop:int,loss:boolean>>"


def format_conversations(rows: DataFrame, template=instruction_template, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: id, the formatted text, the first turn at which the template rewrites history (null: none; then the
    text is the whole rendering and there are no spans), roles, and per turn its span, its text's span and whether it is under the loss mask."""
    turns = rows.select(rows[id_col].alias("id"), rows[turn_col].alias("turn"), F.coalesce(rows[role_col], F.lit("")).alias("role"), F.coalesce(rows[text_col], F.lit("")).alias("text"))
    kind = type_of(rows, id_col)

    def run(batches):
        for batch in batches:
            found = []
            for turns in batch.column(1).to_pylist():
                pairs = [(t["role"], t["text"]) for t in turns]
                try:
                    f = format_chat(pairs, template)
                    spans = [{"start": s[0], "stop": s[1], "text_start": t[0], "text_stop": t[1], "loss": p[0] in loss_roles} for s, t, p in zip(f.spans, f.texts, pairs, strict=True)]
                    found.append((f.text, None, [p[0] for p in pairs], spans))
                except RewritesHistory as e:
                    found.append((template(pairs), e.turn, [p[0] for p in pairs], []))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.list_(pa.string()), SPANS)))],
                ["id", "formatted", "rewrites_at", "roles", "spans"],
            )

    gathered = turns.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return gathered.mapInArrow(run, f"id {kind}, {OUT}").withColumnRenamed("id", id_col)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text_start", pa.int32()), ("text_stop", pa.int32()), ("loss", pa.bool_())]))


def instruction_role(piece: Column) -> Column:
    """The role of a turn, from what ``instruction_template`` adds for it: its text is escaped, so only markup looks like markup."""
    named = F.regexp_replace(F.regexp_extract(piece, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1), UNESCAPE, "$1")
    return F.when(piece.startswith("[INST] "), F.lit("user")).when(piece.startswith("[ROLE]"), named).otherwise(F.lit("assistant"))


#: What undoes ``escape`` in Spark, as ``_ESCAPED`` does in Python.
UNESCAPE = r"(?s)\\(.)"


def read_back(formatted: DataFrame, role_of: Callable[[Column], Column] = instruction_role) -> DataFrame:
    """Adds turns (role, text, loss), read from the formatted text by the spans (the role from the markup, by ``role_of``), and loss_text: the unescaped texts under the mask, in order."""

    def of(s):
        cut = lambda a, b: F.substring(F.col("formatted"), s[a] + 1, s[b] - s[a])
        return F.struct(role_of(cut("start", "stop")).alias("role"), F.regexp_replace(cut("text_start", "text_stop"), UNESCAPE, "$1").alias("text"), s["loss"].alias("loss"))

    return formatted.withColumn("turns", F.transform("spans", of)).withColumn("loss_text", F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), ""))
