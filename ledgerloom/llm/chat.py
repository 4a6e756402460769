"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns, and whether to open the next
assistant turn, to one string. Spans are never computed from the template's source: prefixes
of the conversation are rendered one turn longer each time and consecutive outputs compared.
What the longer output adds is the new turn's span; if the shorter output is no prefix of the
longer one, the template rewrites history, which is reported with the position where the two
part. Within a turn, what stands before and after the text is found by rendering the same turn
with two probe texts, which differ in their first and last characters. Every turn is probed, as a template may
count turns or treat the last one apart. Where a template rewrites history, spans in earlier
outputs say nothing of the last one; each text is then looked for in the last output by probing its turn
in the whole conversation. A conversation of n turns takes 3 n renderings, of its prefixes or of the whole.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn], bool], str]

START, END, SEPARATOR = "<|im_start|>", "<|im_end|>", "\n"


def escaped(text: str) -> str:
    """No control string is left in the result, and ``unescaped`` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    out, i = [], 0
    while (j := text.find("\\", i)) >= 0:
        out.append(text[i:j])
        out.append(text[j + 1 : j + 2])
        i = j + 2
    return "".join([*out, text[i:]])


@functools.lru_cache(1024)
def _marked(role: str, text: str) -> str:
    """One turn: its prefixes and probes render it again and again."""
    return f"{START}{escaped(role).replace(SEPARATOR, chr(92) + SEPARATOR)}{SEPARATOR}{escaped(text)}{END}{SEPARATOR}"


def chat_template(turns: list[Turn], open_assistant: bool = False) -> str:
    """Marked turns with escaped roles and texts; a role's line ends are escaped too."""
    parts = [_marked(role, text) for role, text in turns]
    if open_assistant:
        parts.append(f"{START}assistant{SEPARATOR}")
    return "".join(parts)


@dataclass
class Span:
    """Of one turn, in the whole output: the turn, and its text in it.

    ``rewrites_at`` is where the prefix that ends with the turn parts from the one before, if that is no prefix of it.
    If any turn does so, a turn's span reaches from the end of the text before it to the end of its text, and all four are null
    where the output does not depend on the text.
    """

    start: int | None
    end: int | None
    text_start: int | None
    text_end: int | None
    rewrites_at: int | None


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by comparing halves: whole slices at a time, not character by character."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _common_end(a: str, b: str, most: int) -> int:
    """Length of the common suffix, at most ``most``."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if a[len(a) - middle : len(a) - low] == b[len(b) - middle : len(b) - low]:
            low = middle
        else:
            high = middle - 1
    return low


#: Probe texts: what their outputs share at the start and at the end is not text.
PROBES = "x", "y"


def _place(template: Template, turns: list[Turn], k: int, output: str) -> tuple[int, int] | None:
    """Where the text of turn k stands in the output for ``turns``; None if the output does not depend on it."""
    a, b = (template([*turns[:k], (turns[k][0], p), *turns[k + 1 :]], False) for p in PROBES)
    if a == b:
        return None
    head, tail = _common(a, b), _common_end(a, b, min(len(a), len(b)))
    return head, max(head, len(output) - tail)


def render(template: Template, turns: list[Turn]) -> tuple[str, list[Span]]:
    """The whole output, and a span for each turn."""
    before, spans = template([], False), []
    for k in range(len(turns)):
        now = template(turns[: k + 1], False)
        whole = now.startswith(before)
        start = len(before) if whole else _common(before, now)
        place = _place(template, turns[: k + 1], k, now)
        spans.append(Span(start, len(now), *(place or (None, None)), None if whole else start))
        before = now
    if any(s.rewrites_at is not None for s in spans):
        places = [_place(template, turns, k, before) or (None, None) for k in range(len(turns))]
        ends = sorted(p[1] for p in places if p[0] is not None)
        before_it = lambda at: ends[i - 1] if (i := bisect.bisect_left(ends, at)) else 0
        spans = [Span(None if p[0] is None else before_it(p[0]), p[1], *p, s.rewrites_at) for s, p in zip(spans, places, strict=True)]
    return before, spans


def read_back(formatted: str, spans: list[Span]) -> list[Turn]:
    """The turns as the output has them: the role from what stands before the text; empty where the output has no such text."""
    out = []
    for s in spans:
        if s.text_start is None:
            out.append(("", ""))
            continue
        head = formatted[s.start : s.text_start]
        role = head[head.rfind(START) + len(START) : -len(SEPARATOR)] if START in head else ""
        out.append((unescaped(role), unescaped(formatted[s.text_start : s.text_end])))
    return out


def format_conversations(rows: DataFrame, template: Template = chat_template, *, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, spans, roles, loss_mask, rewrites_history.

    ``loss_mask`` lists the [start, end) code points of the trained role's texts in the output, as far as it has them. Turns are
    ordered by turn, then role, then text (nulls first); a null text is empty, a null role is the
    empty role; rows with a null conv_id form one conversation of their own; repeated rows are
    repeated turns. Further columns of ``rows`` are ignored. An empty table gives no rows.
    """
    turns = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    schema = "conv_id bigint, formatted string, spans array<struct<start:bigint,end:bigint,text_start:bigint,text_end:bigint>>, roles array<string>, loss_mask array<array<bigint>>, rewrites_history boolean"
    arrow = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("formatted", pa.string()),
            ("spans", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "text_start", "text_end")]))),
            ("roles", pa.list_(pa.string())),
            ("loss_mask", pa.list_(pa.list_(pa.int64()))),
            ("rewrites_history", pa.bool_()),
        ]
    )

    def run(batches):
        for batch in batches:
            out = []
            for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs = [(t["role"], t["text"]) for t in turns]
                formatted, spans = render(template, pairs)
                out.append(
                    {
                        "conv_id": conv_id,
                        "formatted": formatted,
                        "spans": [{"start": s.start, "end": s.end, "text_start": s.text_start, "text_end": s.text_end} for s in spans],
                        "roles": [r for r, _ in pairs],
                        "loss_mask": [[s.text_start, s.text_end] for (r, _), s in zip(pairs, spans, strict=True) if r == trained_role and s.text_start is not None],
                        "rewrites_history": any(s.rewrites_at is not None for s in spans),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, arrow)

    return grouped.mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what is read back from the output: turn and loss digests."""
    import hashlib

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites_history boolean"

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                turns = read_back(r["formatted"], [Span(**s, rewrites_at=None) for s in r["spans"]])
                loss = "".join(unescaped(r["formatted"][a:b]) for a, b in r["loss_mask"])
                out.append((r["conv_id"], len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r["formatted"]), r["rewrites_history"]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=formatted_names)

    formatted_names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
    return formatted.mapInArrow(run, schema)
