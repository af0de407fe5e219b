r"""Chat formatting through a black-box template.

A template is any function from a list of turns (``role``, ``text``) to a
string. Successive prefixes of a conversation are rendered; when the output
for one more turn begins with the output before it, the rest is that turn's
span, else the template rewrites history and the conversation is marked. The
place of the text inside a span is found by two probes, the same prefix with
the texts ``x`` and ``y`` in the turn's place: where the outputs part, the
text begins, and what follows the probe is the template's closing.

Turns stream through a task sorted by conversation; a conversation's turns are
held once and each prefix is rendered from them, so what a task holds is one
conversation and its output. Rendering every prefix of a black box is quadratic
in the turns of a conversation by nature. For a template known to look at a few
earlier turns only, ``context`` says how many, and only those are rendered.

The template of this module ends turns with a line ``</turn>`` and begins them
with ``### Role:``. Control strings in texts and roles are escaped with a
backslash: backslash itself, ``###`` and ``</turn>`` everywhere, colons and
line ends in roles. ``unescape`` undoes it exactly.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_frames, staged

Turn = tuple[str, str]

_OUT = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t", ":": "\\c", "\n": "\\n", "\r": "\\r"}
_BACK = {v[1]: k for k, v in _OUT.items()}
_IN_TEXT = re.compile(r"\\|###|</turn>")
_IN_ROLE = re.compile(r"\\|###|</turn>|:|\n|\r")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ([^:\n]*):\n(.*?)\n</turn>\n", re.S)


def escape(text: str) -> str:
    return _IN_TEXT.sub(lambda m: _OUT[m[0]], text)


def escape_role(role: str) -> str:
    return _IN_ROLE.sub(lambda m: _OUT[m[0]], role)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


#: Short rendered turns, kept for the next prefix; emptied when full.
_RENDERED: dict[Turn, str] = {}
KEPT_TURNS, KEPT_CHARS = 1 << 14, 2048


def _marked(turn: Turn) -> str:
    out = _RENDERED.get(turn)
    if out is None:
        out = f"### {escape_role(turn[0])}:\n{escape(turn[1])}\n</turn>\n"
        if len(out) <= KEPT_CHARS:
            if len(_RENDERED) >= KEPT_TURNS:
                _RENDERED.clear()
            _RENDERED[turn] = out
    return out


def marked_turns(turns: list[Turn]) -> str:
    """The template: each turn between a role line and an end line."""
    return "".join(map(_marked, turns))


def parse_turn(span: str) -> Turn:
    """Role and text of one formatted turn."""
    m = _TURN.fullmatch(span)
    if not m:
        raise ValueError(f"not a formatted turn: {span[:60]!r}")
    return unescape(m[1]), unescape(m[2])


def locate(template: Callable[[list[Turn]], str], earlier: list[Turn], turn: Turn,
           before: str | None = None) -> tuple[str, int, int] | None:
    """``(span, begin, end)`` of a turn after ``earlier``; None when history is rewritten.

    ``begin`` and ``end`` bound the text's rendering inside the span;
    ``before`` is the output for ``earlier``, where it is known.
    """
    return _locate(template, earlier, turn, before)[0]


def _locate(template, earlier: list[Turn], turn: Turn, before: str | None):
    """``locate``, and the output with the turn."""
    if before is None:
        before = template(earlier) if earlier else ""
    after = template([*earlier, turn])
    x, y = template([*earlier, (turn[0], "x")]), template([*earlier, (turn[0], "y")])
    if not (after.startswith(before) and x.startswith(before) and y.startswith(before)):
        return None, after
    span, x, y = after[len(before):], x[len(before):], y[len(before):]
    begin = len(os.path.commonprefix((x, y)))
    closing = len(x) - begin - 1
    if closing < 0 or x[begin + 1:] != y[begin + 1:] or span[:begin] != x[:begin] or len(span) < begin + closing:
        return None, after
    return (span, begin, len(span) - closing), after


_WHOLE = {"conv_id", "pos", "loss_begin", "loss_end", "n_turns", "loss_chars", "formatted_chars"}


def _typed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """A frame whose whole numbers keep their values beside nulls."""
    return pd.DataFrame({n: pd.array(list(c), dtype="Int64") if n in _WHOLE else list(c) for n, c in zip(names, zip(*rows))})


def format_turns(turns: DataFrame, *, template: Callable[[list[Turn]], str] = marked_turns,
                 context: int | None = None,
                 conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 learn: str = "assistant") -> DataFrame:
    """One row per turn: ``conv_id, pos, span, loss_begin, loss_end, rewritten``.

    The spans of a conversation in order of ``pos`` are its formatted text;
    ``loss_begin`` and ``loss_end`` bound the learned text inside the span
    (null for turns of other roles). ``rewritten`` marks turns at which the
    template changed what it had put out before; they have no span. Rows are
    ordered by turn, then role, then text, nulls first, so repeated turns stay
    and ties are settled; a null role or text is empty; rows without conv_id
    form one conversation. A conversation is rendered by one task, since each
    prefix needs all turns before; texts of any length are kept whole.
    """
    clean = turns.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
                         F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = (clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select(F.col("conv_id").cast("string").alias("conv"), "role", "text"))  # as text: pandas has no whole numbers with nulls

    def run(frames):
        key, pos, earlier, before = None, 0, [], None
        for pdf in frames:
            out = []
            for conv, r, t in zip(pdf["conv"], pdf["role"], pdf["text"]):
                mine = (None if conv is None else int(conv),)
                if mine != key:
                    key, pos, earlier, before = mine, 0, [], None
                if context is not None:  # a window of earlier turns, rendered anew as it moves
                    earlier, before = earlier[len(earlier) - context:] if context and len(earlier) > context else (
                        earlier if context else []), None
                got, after = _locate(template, earlier, (r, t), before)
                span, a, b = got or (None, None, None)
                out.append((*mine, pos, span, *((a, b) if r == learn else (None, None)), got is None))
                earlier.append((r, t))
                pos, before = pos + 1, after
            if out:
                yield _typed(out, ["conv_id", "pos", "span", "loss_begin", "loss_end", "rewritten"])

    return map_frames(rows, run, "conv_id long, pos long, span string, loss_begin long, loss_end long, rewritten boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from its formatted turns alone.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, rewritten``. Turns arrive sorted by conversation and
    position and are hashed one after the other as they pass, so a
    conversation of any length is never held; one that any template rewrote
    gets null digests and ``rewritten`` true.
    """
    rows = (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
            .select(F.col("conv_id").cast("string").alias("conv"), "span", "loss_begin", "loss_end"))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"]

    def run(frames):
        key, state = None, None

        def closed():
            n, turns, chars, loss, size, bad = state
            return (key[0], n, None if bad else turns.hexdigest(), None if bad else chars,
                    None if bad else loss.hexdigest(), None if bad else size, bad)

        for pdf in frames:
            done = []
            for conv, span, a, b in zip(pdf["conv"], pdf["span"], pdf["loss_begin"], pdf["loss_end"]):
                mine = (None if conv is None else int(conv),)
                if mine != key:
                    if key is not None:
                        done.append(closed())
                    key, state = mine, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                state[0] += 1
                if span is None:
                    state[5] = True
                    continue
                role, text = parse_turn(span)
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[4] += len(span)
                if not pd.isna(a):
                    learned = unescape(span[int(a):int(b)])
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
            if done:
                yield _typed(done, names)
        if key is not None:
            yield _typed([closed()], names)

    return map_frames(rows, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                 "formatted_chars long, rewritten boolean")


def format_conversations(turns: DataFrame, **options) -> DataFrame:
    """Format all conversations, write the formatted turns, read them back (see ``read_back``).

    An empty table gives an empty one; columns other than the four are not read.
    """
    return read_back(staged(format_turns(turns, **options), "formatted-turns"))
