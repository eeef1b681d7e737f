"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. The formatter knows
nothing about it: it renders the conversation's prefixes one turn longer each time and compares
consecutive outputs. If the shorter one is a prefix of the longer one, the rest is the new turn's
span; if not, the template rewrites history and the conversation is flagged (its spans are then taken from the
last render alone, by the longest common prefix). Where in its span a turn's text lies is found by rendering
each turn with two probe texts: what both outputs and the span share before and after is the turn's frame.

Every prefix is rendered whole, however many turns it has. For a template that is known to look back
fewer than some number of turns, as the query's own, a caller may state that as ``window``: longer prefixes are
then rendered without their early turns, which takes time in proportion to the conversation. The sum is held
against one whole render, and where they differ, the whole prefixes are rendered after all.

``render`` is the template of the query: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``, and a
bar is put after each ``<|`` inside a text, which ``unescape`` takes out again, so no text can
forge a mark. ``parse`` reads turns back from an output.

Defined cases: null role or text is empty; turns are in order of turn, null first, then role and
text; repeated rows are turns of their own; rows with a null conv_id are one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: The query's template renders a turn by itself, so this many turns are more than it looks back.
WINDOW = 64
SCHEMA = "conv_id long, n_turns long, formatted string, spans array<struct<role:string,begin:long,end:long,text_begin:long,text_end:long>>, rewrites boolean"
Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]


def escape(text: str) -> str:
    return text.replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape("\\".join(part.replace("\\n", "\n") for part in role.split("\\\\")))


def render(turns: list[Turn]) -> str:
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def parse(output: str) -> list[Turn]:
    """The turns of an output of ``render``."""
    turns, at = [], 0
    while at < len(output):
        if not output.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = output.index("\n", at)
        end = output.index(END, line)
        turns.append((unescape_role(output[at + len(START) : line]), unescape(output[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a.startswith(b[:mid]):
            low = mid
        else:
            high = mid - 1
    return low


#: They differ in the first and last character, so a frame is not taken too wide.
_PROBES = ("⁂a⁃", "⁄bb⁅")


class Formatter:
    """Formats conversations with a black-box template, and locates every turn and its text."""

    def __init__(self, template: Template, window: int | None = None):
        self.template, self.window = template, window

    def frame(self, context: list[Turn], role: str, before: int, span: str) -> tuple[int, int]:
        """Characters before and after the text in ``span``, that of a turn of ``role`` after ``context``,
        whose output has ``before`` characters."""
        a, b = (self.template([*context, (role, p)])[before:] for p in _PROBES)
        head = min(_common(a, b), _common(a, span))
        tail = min(_common(a[head:][::-1], b[head:][::-1]), _common(a[head:][::-1], span[head:][::-1]))
        return head, tail

    def __call__(self, turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]], bool]:
        """(output, (begin, end, text_begin, text_end) of each turn, whether history is rewritten)."""
        if self.window and len(turns) > self.window:
            found = self._incremental(turns, self.window)
            if found and self.template(turns) == found[0]:
                return (*found, False)
        found = self._incremental(turns, len(turns))
        return (*found, False) if found else (*self._rewritten(turns), True)

    def _incremental(self, turns: list[Turn], window: int) -> tuple[str, list[tuple[int, int, int, int]]] | None:
        """(output, spans) by consecutive prefixes, of which the last ``window`` turns are rendered; None if one
        is not continued by the next."""
        spans, parts, shown = [], [], ""
        for i in range(len(turns)):
            base = max(0, i + 1 - window)
            context = turns[base:i]
            if base:  # a sliding window; what it starts with is not part of any span
                shown = self.template(context)
            after = self.template(turns[base : i + 1])
            if not after.startswith(shown):
                return None
            span = after[len(shown) :]
            frame = self.frame(context, turns[i][0], len(shown), span)
            at = spans[-1][1] if spans else 0
            spans.append((at, at + len(span), at + frame[0], at + len(span) - frame[1]))
            parts.append(span)
            shown = after
        return "".join(parts), spans

    def _rewritten(self, turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]]]:
        """Each turn of the final output: where it stops following a render without this turn."""
        output, spans, at = self.template(turns), [], 0
        for i, (role, _) in enumerate(turns):
            a, b = (self.template([*turns[:i], (role, p), *turns[i + 1 :]]) for p in _PROBES)
            head = _common(a, b)
            tail = _common(a[head:][::-1], b[head:][::-1])
            end = max(head, len(output) - tail)
            spans.append((at, end, min(head, end), end))
            at = end
        return output, spans


def formatted(conversations: DataFrame, template: Template = render, window: int | None = None) -> DataFrame:
    """Per conversation: conv_id, n_turns, formatted, spans (offsets in code points), rewrites.

    Rows are spread by conv_id and sorted within tasks, so a task holds one conversation at a time. The
    template ``render`` needs no ``window``: ``WINDOW`` is used for it.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    span = pa.struct([("role", pa.string()), *((n, pa.int64()) for n in ("begin", "end", "text_begin", "text_end"))])
    types = (pa.int64(), pa.int64(), pa.string(), pa.list_(span), pa.bool_())

    window = WINDOW if window is None and template is render else window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Formatter(template, window)
        out: list[tuple] = []
        current, turns, chars = None, [], 0

        def done():
            nonlocal chars
            text, spans, rewrites = one(turns)
            chars += len(text)
            fields = [{"role": r, "begin": b, "end": e, "text_begin": x, "text_end": y} for (r, _), (b, e, x, y) in zip(turns, spans, strict=True)]
            out.append((current, len(turns), text, fields, rewrites))

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["conv_id", "n_turns", "formatted", "spans", "rewrites"])

        for batch in batches:
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if turns and conv != current:
                    done()
                    turns = []
                    if len(out) >= 500 or chars > 1 << 22:
                        yield batch_of()
                        out.clear()
                        chars = 0
                current = conv
                turns.append((role, text))
        if turns:
            done()
        if out:
            yield batch_of()

    return rows.mapInArrow(run, SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """What the output says when read back: turns by ``parse``, loss text by the spans of assistant turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                turns = parse(text)
                every, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, said in turns:
                    every.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    if s["role"] == "assistant":
                        own = unescape(text[s["text_begin"] : s["text_end"]])
                        chars += len(own)
                        loss.update(own.encode("utf-8", "surrogatepass"))
                rows.append((conv, len(turns), every.hexdigest(), chars, loss.hexdigest(), len(text)))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return found.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
