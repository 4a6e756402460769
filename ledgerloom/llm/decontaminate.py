"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised items become one automaton over word numbers. Training texts stream through
it word by word; at each word the automaton knows the longest item passage that ends there.
A passage of ``window`` words or more marks its words as hit, and so does a whole item that
is shorter than a window. Words that no item has reset the automaton, so runs of known words
that are too short for any window are skipped in bulk.

The automaton is built from a bounded number of item words; more items make more automata,
through which the texts pass one after another. A pass is a narrow map: no shuffle, and the
training texts are never gathered anywhere.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.shared import forget, free_name, texts, written

#: Every byte that is no word byte becomes a space, A-Z become a-z; words are then what split() gives.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    """Normalised words; lone surrogates can't occur in Spark strings."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Automaton:
    """Generalised suffix automaton over word numbers.

    ``items`` is a list of (item_id, words). Almost every state has one way on, which flat arrays hold; the
    few that branch have the others in a dictionary. ``occurs`` has the items that hold the last ``window``
    words read, by the state that ``at_window`` gives for the present one; ``ends`` the short items that end in a
    state, which ``short_at`` gives. Of ``size`` bytes, about.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = 13):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link = array("i", [0]), array("i", [-1])
        self.way, self.next, self.more = array("i", [-1]), array("i", [-1]), {}
        paths: list[tuple[str, array]] = []
        for item_id, words in items:
            numbers = array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
            if not numbers:
                continue
            last = 0
            for c in numbers:
                last = self._extend(last, c)
            paths.append((item_id, numbers))
        self.shortest = min([window, *(len(n) for _, n in paths)])
        short: dict[int, set[tuple[int, str]]] = {}
        for item_id, numbers in paths:
            if len(numbers) < window:
                state = 0
                for c in numbers:
                    state = self.to(state, c)
                short.setdefault(state, set()).add((len(numbers), item_id))
        # The state of the last ``window`` words is the suffix-link ancestor whose lengths hold ``window``.
        n = len(self.length)
        self.at_window, self.short_at, self.ends = array("i", bytes(4 * n)), array("i", bytes(4 * n)), {}
        for state in np.argsort(np.frombuffer(self.length, np.int32), kind="stable")[1:].tolist():
            parent = self.link[state]
            if self.length[state] >= window:
                self.at_window[state] = state if self.length[parent] < window else self.at_window[parent]
            above = self.short_at[parent]
            self.short_at[state] = above
            if state in short:
                self.short_at[state] = state
                self.ends[state] = tuple(sorted({*self.ends.get(above, ()), *short[state]}))
        held: dict[int, set[str]] = {}
        for item_id, numbers in paths:
            state = 0
            for c in numbers:
                state = self.to(state, c)
                if at := self.at_window[state]:
                    held.setdefault(at, set()).add(item_id)
        self.occurs = {state: tuple(sorted(ids)) for state, ids in held.items()}

    @property
    def size(self) -> int:
        flat = (self.length, self.link, self.way, self.next, self.at_window, self.short_at)
        return 4 * sum(map(len, flat)) + 300 * len(self.more) + 120 * (len(self.occurs) + len(self.ends)) + 110 * len(self.vocabulary)

    def to(self, state: int, c: int) -> int:
        """The state after the word ``c``, -1 if there is none."""
        if self.way[state] == c:
            return self.next[state]
        others = self.more.get(state)
        return others.get(c, -1) if others else -1

    def _lead(self, state: int, c: int, target: int) -> None:
        if self.way[state] in (-1, c):
            self.way[state], self.next[state] = c, target
        else:
            self.more.setdefault(state, {})[c] = target

    def _state(self, length: int, link: int) -> int:
        for column, value in ((self.length, length), (self.link, link), (self.way, -1), (self.next, -1)):
            column.append(value)
        return len(self.length) - 1

    def _extend(self, last: int, c: int) -> int:
        q = self.to(last, c)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state(self.length[last] + 1, 0)
        p = last
        while p >= 0 and self.to(p, c) < 0:
            self._lead(p, c, new)
            p = self.link[p]
        if p >= 0:
            q = self.to(p, c)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, self.link[q])
        self.way[twin], self.next[twin] = self.way[q], self.next[q]
        if q in self.more:
            self.more[twin] = dict(self.more[q])
        self.link[q] = twin
        while p >= 0 and self.to(p, c) == q:
            self._lead(p, c, twin)
            p = self.link[p]
        return twin

    def spans(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Disjoint spans [start, end) of hit words, in order, and the items whose windows occur."""
        number = self.vocabulary.get
        numbers = np.fromiter([number(w, -1) for w in words], np.int64, len(words))
        known = np.concatenate([[0], (numbers >= 0).view(np.int8), [0]])
        step = np.diff(known)
        starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long = stops - starts >= self.shortest
        out: list[list[int]] = []
        found: set[str] = set()
        for start, stop in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            self._stream(numbers[start:stop].tolist(), start, out, found)
        return out, found

    def _stream(self, numbers: list[int], at: int, out: list[list[int]], found: set[str]) -> None:
        to, link, length, window = self.to, self.link, self.length, self.window
        state = matched = 0
        for i, c in enumerate(numbers, at + 1):
            ahead = to(state, c)
            while state and ahead < 0:
                state = link[state]
                matched = length[state]
                ahead = to(state, c)
            if ahead >= 0:
                state = ahead
                matched += 1
            if matched >= window:
                _mark(out, i - matched, i)
                found.update(self.occurs[self.at_window[state]])
            if short := self.short_at[state]:
                for n, item_id in self.ends[short]:
                    if n <= matched:
                        _mark(out, i - n, i)
                        found.add(item_id)


def _mark(out: list[list[int]], start: int, end: int) -> None:
    """Add a span whose end is not before that of any other."""
    while out and out[-1][1] >= start:
        start = min(start, out.pop()[0])
    out.append([start, end])


def _joined(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted([*a, *b]):
        if out and out[-1][1] >= start:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


#: Item words of one automaton. A word makes two states at most, of 24 bytes each, so one takes 100 MB or less with its dictionaries.
WORDS_EACH = 1_000_000


def automata(benchmark: DataFrame, window: int = 13, words_each: int = WORDS_EACH) -> Iterator[Automaton]:
    """One automaton after another, of at most ``words_each`` item words each (one item at least); items come one by one, in order of id.

    A benchmark is short beside what it is held against: the driver holds one automaton of a bounded size at a time.
    """
    items, n = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).dropna().orderBy("i", "t")
    for r in rows.toLocalIterator():
        words = words_of(r.t)
        if items and n + len(words) > words_each:
            yield Automaton(items, window)
            items, n = [], 0
        items.append((r.i, words))
        n += len(words)
    yield Automaton(items, window)


def find(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = 13, words_each: int = WORDS_EACH, into: str = "contamination") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, hit_spans (of word numbers, end exclusive) and item_ids.

    Null and empty texts have no words and no hits; repeated rows are judged alike, each on its
    own; an empty benchmark hits nothing; items with null id or text take no part. Columns of
    ``docs`` are kept whatever they are called; ``into`` must be a new name.
    """
    if into in docs.columns:
        raise ValueError(f"docs already has a column {into}")
    spark = docs.sparkSession
    kept = docs.columns
    for k, automaton in enumerate(automata(benchmark, window, words_each)):
        if k:
            docs = written(docs, "decontaminate")
        shared = spark.sparkContext.broadcast(automaton)
        first = k == 0
        schema = T.StructType([*[f for f in docs.schema.fields if f.name != into], T.StructField(into, FOUND)])

        def judge(batches, shared=shared, first=first, arrow=_arrow(FOUND)):
            forget()
            automaton = shared.value
            for batch in batches:
                names = batch.schema.names
                before = [None] * batch.num_rows if first else batch.column(names.index(into)).to_pylist()
                found = []
                for t, b in zip(texts(batch.column(names.index(text))), before, strict=True):
                    words = words_of(t)
                    spans, items = automaton.spans(words)
                    if b:
                        spans, items = _joined(spans, b["hit_spans"]), items | set(b["item_ids"])
                    found.append({"n_words": len(words), "hit_spans": spans, "item_ids": sorted(items)})
                columns = [batch.column(names.index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, arrow)], names=[*kept, into])

        docs = docs.mapInArrow(judge, schema)
    return docs


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def n_hit(into: str = "contamination") -> Column:
    return F.aggregate(F.col(f"{into}.hit_spans"), F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def contaminated(into: str = "contamination", coverage: float = 0.05) -> Column:
    """Some word is hit and hits make up ``coverage`` of the words or more (in whole thousandths, so compared exactly)."""
    return (n_hit(into) > 0) & (1000 * n_hit(into) >= round(coverage * 1000) * F.col(f"{into}.n_words"))


def cut_text(text: str | None, spans: list[list[int]]) -> str | None:
    """The text without the hit words and what stands between words of one span."""
    if not spans:
        return text
    at = [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010FFFF]+", text or "")]
    out, last = [], 0
    for start, end in spans:
        out.append((text or "")[last : at[start][0]])
        last = at[end - 1][1]
    return "".join([*out, (text or "")[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = 13, coverage: float = 0.05, action: str = "drop") -> DataFrame:
    """Clean ``docs``, same columns.

    ``drop`` removes documents whose hits reach ``coverage`` and leaves all others as they are;
    ``cut`` also removes the hit spans from the texts of the others.
    """
    into = free_name(docs, "__contamination")
    kept = find(docs, benchmark, text=text, window=window, into=into).where(~contaminated(into, coverage))
    if action == "cut":
        names = docs.columns

        def cut(batches):
            for batch in batches:
                columns = {c: batch.column(batch.schema.names.index(c)) for c in [*names, into]}
                hits = [x["hit_spans"] for x in columns[into].to_pylist()]
                columns[text] = pa.array([cut_text(t, spans) for t, spans in zip(columns[text].to_pylist(), hits, strict=True)], columns[text].type)
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

        return kept.mapInArrow(cut, docs.schema)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
