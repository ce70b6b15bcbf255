"""Chat formatting with a template that is only ever called, never parsed."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended

Turns = Sequence[tuple[str, str]]


@dataclass(frozen=True)
class Template:
    """``render`` turns (role, text) into one string; ``unescape`` undoes what it does to a text."""

    render: Callable[[Turns], str]
    unescape: Callable[[str], str] = str


# -- the default template -----------------------------------------------------------------

# fixed values: control strings <s> </s> [INST] [/INST]
_CONTROL = re.compile(r"([<\[])(\\*)(?=/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[])(\\*)\\(?=/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>\n", re.DOTALL)


def escape(text: str) -> str:
    """A backslash more after the first character of anything like a control string."""
    return _CONTROL.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render_inst(turns: Turns) -> str:
    """``<s>role``, a line with the text (a user's between [INST] marks), ``</s>``, turn after turn."""
    out = []
    for role, text in turns:
        name = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
        body = escape(text)
        out.append(f"<s>{name}\n[INST] {body} [/INST]</s>\n" if role == "user" else f"<s>{name}\n{body}</s>\n")
    return "".join(out)


def read_inst(formatted: str) -> list[tuple[str, str]]:
    """The turns of a string that :func:`render_inst` made."""
    turns = []
    for name, body in _TURN.findall(formatted):
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(name))
        turns.append((role, unescape(body.removeprefix("[INST] ").removesuffix(" [/INST]") if role == "user" else body)))
    return turns


INST = Template(render_inst, unescape)


# -- locating turns -----------------------------------------------------------------------


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] is common, a[:hi] is not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def locate(template: Template, turns: Turns) -> tuple[str, list[tuple[int, int, int, int, int]], int | None]:
    """(output, spans, rewritten): spans are (turn, start, end, text start, text end) in the output.

    Every prefix of the turns is rendered. If the output of one more turn begins with the output
    before it, what was added is that turn's span. Otherwise the template rewrites history:
    ``rewritten`` is the first such turn, and turns that the change reaches lose their spans. Where
    the text lies in a span is found by two more renderings, with two different short texts in its
    place: what they share at either side is the template's.
    """
    before, spans, rewritten = template.render([]), [], None
    for k, (role, text) in enumerate(turns):
        head = list(turns[:k])
        now = template.render([*head, (role, text)])
        if not now.startswith(before):
            rewritten = k if rewritten is None else rewritten
            same = _common(before, now)
            spans = [s for s in spans if s[2] <= same]
        else:
            at = len(before)
            a, b = (template.render([*head, (role, probe)]) for probe in ("x", "y"))
            if a.startswith(before) and b.startswith(before):
                left = at + _common(a[at:], b[at:])
                right = _common(a[left:][::-1], b[left:][::-1])
                end = len(now) - right
                if left <= end and now[at:left] == a[at:left] and now[end:] == a[len(a) - right :]:
                    spans.append((k, at, len(now), left, end))
        before = now
    return before, spans, rewritten


SPANS = "array<struct<turn:int,role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean>>"


def format_chats(turns: DataFrame, template: Template = INST, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, n_turns, formatted, spans, rewritten_at) per conversation.

    Rows are ordered by turn, null first; rows of the same turn by role and text, so repeated rows
    stay, in a fixed order. Null role and null text count as empty. Rows with a null conversation
    form one conversation with a null id. ``spans`` holds the turns that could be located, with
    ``loss`` on those of ``loss_roles``: the loss mask is their text range. ``rewritten_at`` is null
    for a template that only appends. A conversation is one string, so it is also one task's; the
    renderings of n turns cost n squared. Other columns are ignored; no rows give no rows.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("_turns"))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        n, texts, found, rewritten = [], [], [], []
        for chat in batch.column("_turns"):
            own = [(t["role"], t["text"]) for t in chat.as_py()]
            out, spans, changed = locate(template, own)
            n.append(len(own))
            texts.append(out)
            rewritten.append(changed)
            found.append([
                {"turn": k, "role": own[k][0], "start": a, "end": b, "text_start": c, "text_end": d, "loss": own[k][0] in loss_roles}
                for k, a, b, c, d in spans])
        kind = pa.list_(pa.struct([("turn", pa.int32()), ("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                   ("text_start", pa.int32()), ("text_end", pa.int32()), ("loss", pa.bool_())]))
        return [pa.array(n, pa.int64()), pa.array(texts, pa.string()), pa.array(found, kind), pa.array(rewritten, pa.int32())]

    fields = {"n_turns": "bigint", "formatted": "string", "spans": SPANS, "rewritten_at": "int"}
    return appended(chats, run, fields).drop("_turns")


def loss_text(formatted: str, spans: list[dict], template: Template = INST) -> str:
    """All text under the loss mask, unescaped, in order and without anything between."""
    return "".join(template.unescape(formatted[s["text_start"] : s["text_end"]]) for s in spans if s["loss"])
