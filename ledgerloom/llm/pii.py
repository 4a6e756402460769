"""Personal data by fixed patterns, and more by bootstrapped contexts.

What the fixed patterns find are seed entities. They induce patterns of three lexical families (the word before an
entity, the word after it, two words before with one after) and of two families of form (the entity's own shape, and its outline: the
shape without lengths, if it has several parts). Patterns and instances (seeds, and candidate tokens that look like
identifiers) form a graph, which Spark scores in rounds: a pattern's confidence is the mean score of its instances, an
instance's score the mean confidence of its patterns, and seeds keep score 1. A lexical pattern is measured by every
occurrence of its words in the texts, whatever stands there, and needs the support of several distinct instances: so a word that
stands before anything ("the") says nothing, and neither does one that stands before one value again and again. A
candidate is an identifier that the fixed patterns don't know if a lexical pattern of high confidence holds it, or one of
less confidence and its form agree. Form alone is never enough: a long number that fails the card checksum stays.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Container

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import bounded, forget, free_name, hot_keys, split_join, texts, written

#: Kinds in the order in which they are listed.
KINDS = ["email", "ip", "card", "phone"]
#: Kind of what contexts discover.
FOUND = "context"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Tokens that look like identifiers: a run of letters, digits and joiners with four digits or more, or one with an at sign.
_CANDIDATE = re.compile(r"(?<![^\s])[(\[\"']*([A-Za-z0-9+][A-Za-z0-9._/:@+-]{3,}[A-Za-z0-9])[)\]\"'.,;:!?]*(?![^\s])")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d)
        if k % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches: for each at sign, the longest run of local characters before it (since the last match), then a domain."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted: leftmost non-overlapping matches of each kind; failing ones are dropped."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


#: Families of patterns, by the letter that a pattern starts with.
BEFORE, AFTER, AROUND, SHAPE, OUTLINE = "bfaso"


def shape(value: str) -> str:
    """The form of an identifier: runs of digits as 0 and their length, runs of letters as a; a run of both as x and its length."""
    def of(m: re.Match) -> str:
        run = m[0]
        return f"0{len(run)}" if run.isdigit() else "a" if run.isalpha() else f"x{len(run)}"

    return re.sub(r"[^\W_]+", of, value)


def word_ends(text: str) -> tuple[list[int], list[int], list[str]]:
    """Starts, ends and lower-case forms of a text's words."""
    found = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]
    return [a for a, _, _ in found], [b for _, b, _ in found], [w for _, _, w in found]


def patterns(words: tuple[list[int], list[int], list[str]], value: str, start: int, end: int) -> list[str]:
    """The patterns of a span, at most one of each family, wherever in the text its words stand; without words there is no lexical one, and a value of one part has no outline."""
    starts, ends, forms = words
    i, j = bisect_right(ends, start), bisect_left(starts, end)
    before, after = forms[max(0, i - 2) : i], forms[j : j + 1]
    form = shape(value)
    outline = re.sub(r"(?<=[0x])[0-9]+", "", form)
    out = [f"{BEFORE} {before[-1]}"] if before else []
    if after:
        out.append(f"{AFTER} {after[0]}")
    if len(before) == 2 and after:
        out.append(f"{AROUND} {' '.join(before)} _ {after[0]}")
    out.append(f"{SHAPE} {form}")
    return out if outline.isalnum() else [*out, f"{OUTLINE} {outline}"]


def words_of(pattern: str) -> tuple[str, ...] | None:
    """The one or two words whose occurrences a lexical pattern is measured by; None for a pattern of another family."""
    family, _, rest = pattern.partition(" ")
    return (rest,) if family in (BEFORE, AFTER) else tuple(rest.split(" ")[:2]) if family == AROUND else None


def occurrences(text: str, ones: Container[str], pairs: Container[tuple[str, str]], heads: Container[str]) -> Counter:
    """How often the text has each of some words, and of some pairs of neighbours, of which ``heads`` has the first ones."""
    forms = [w.lower() for w in _WORD.findall(text)]
    count = Counter((w,) for w in forms if w in ones)
    count.update(x for x in itertools.pairwise(forms) if x[0] in heads and x in pairs)
    return count


def candidates(text: str, taken: list[tuple[int, int, int]]):
    """Spans that look like identifiers and overlap no base span."""
    k = 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span(1)
        value = m[1]
        if sum(c.isdigit() for c in value) < 4 and "@" not in value:
            continue
        while k < len(taken) and taken[k][2] <= start:
            k += 1
        if not any(a < end and start < b for a, _, b in itertools.takewhile(lambda span: span[0] < end, itertools.islice(taken, k, None))):
            yield start, end, value


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_CONTEXT = pa.struct([("instance", pa.string()), ("patterns", pa.list_(pa.string())), ("seed", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])
_SPAN_SQL = "array<struct<start:bigint,kind:int,end:bigint>>"
_CONTEXT_SQL = "array<struct<instance:string,patterns:array<string>,seed:boolean,start:bigint,end:bigint>>"



def content_of(text: str) -> Column:
    """128 bits by which equal texts are known."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def extracted(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, content, base, contexts) for each row: fixed-pattern spans, and contexts of seeds and candidates. Ids are cast to bigint."""
    schema = pa.schema([("id", pa.int64()), ("content", pa.string()), ("base", pa.list_(_SPAN)), ("contexts", pa.list_(_CONTEXT))])
    digit_or_at = re.compile("[0-9@]")

    def run(batches):
        forget()
        for batch in batches:
            bases, contexts = [], []
            for t in texts(batch.column(2)):
                base, around = [], []
                if digit_or_at.search(t):
                    spans = base_spans(t)
                    base = [{"start": a, "kind": k, "end": b} for a, k, b in spans]
                    found = [(a, b, t[a:b], True) for a, _, b in spans] + [(a, b, v, False) for a, b, v in candidates(t, spans)]
                    if found:
                        words = word_ends(t)
                        around = [{"instance": hashlib.md5(v.lower().encode()).hexdigest(), "patterns": patterns(words, v, a, b), "seed": s, "start": a, "end": b} for a, b, v, s in found]
                bases.append(base)
                contexts.append(around)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bases, schema[2].type), pa.array(contexts, schema[3].type)], schema=schema)

    rows = docs.select(F.col(id).cast("long"), content_of(text), text)
    return rows.mapInArrow(run, f"id bigint, content string, base {_SPAN_SQL}, contexts {_CONTEXT_SQL}")


def score_patterns(edges: DataFrame, measures: DataFrame | None = None, *, rounds: int = 3, prior: float = 2.0, support: float = 3.0) -> DataFrame:
    """(pattern, confidence) from edges (pattern, instance, seed, n): n occurrences of an instance in a pattern.

    An instance of which any edge says so is a seed, with score 1 throughout; the others start at
    0. In each round a pattern's confidence is the weighted mean of its instances' scores, held down by
    ``prior`` occurrences of score 0; the score of an instance that is no seed is then the weighted mean of its
    patterns' confidences. With ``measures`` (pattern, n: all occurrences of its words), occurrences of a lexical pattern's words beside
    what is no instance count with score 0; one that isn't measured, or whose distinct instances' scores sum up to less than ``support``, has
    no confidence. Edges are counted before they are shuffled, so a pattern that a third of all texts hold is one edge for each
    instance; patterns of many instances are joined by broadcast (``hot_keys``).
    """
    is_lexical = F.lit(measures is not None) & F.substring("pattern", 1, 1).isin(BEFORE, AFTER, AROUND)
    if measures is None:
        measures = edges.sparkSession.createDataFrame([], "pattern string, n bigint")
    measures = measures.select("pattern", F.col("n").alias("of_all"))
    hot = hot_keys(edges.groupBy("pattern").agg(F.count("*").alias("edges")), "pattern", "edges")
    score = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    known = written(score.select("instance", F.col("score").alias("known")), "seeds")
    score = known.select("instance", F.col("known").alias("score"))
    for k in range(rounds):
        sums = edges.join(score, "instance").groupBy("pattern").agg(F.sum(F.col("n") * F.col("score")).alias("scores"), F.sum("n").alias("all"), F.sum("score").alias("support"))
        confidence = F.col("scores") / (F.greatest(F.col("all"), F.col("of_all")) + prior)
        weak = is_lexical & (F.col("of_all").isNull() | (F.col("support") < support))
        patterns = sums.join(measures, "pattern", "left").select("pattern", F.when(weak, 0.0).otherwise(confidence).alias("confidence"))
        if k + 1 < rounds:
            mean = split_join(edges, written(patterns, "confidences"), "pattern", hot).groupBy("instance").agg((F.sum(F.col("n") * F.col("confidence")) / F.sum("n")).alias("mean"))
            score = written(mean.join(known, "instance").select("instance", F.greatest("mean", "known").alias("score")), "instances")
    return patterns


def measured(docs: DataFrame, edges: DataFrame, *, text: str = "text", support: float = 3.0, most: int = 200_000) -> DataFrame:
    """(pattern, n) of lexical patterns with ``support`` distinct instances or more: how often all texts have their words. Others can't be of use.

    A pass over the texts takes ``most`` patterns or about as many (broadcast); more patterns take more passes. A task emits a sum a pattern.
    """
    spark = docs.sparkSession
    lexical = edges.where(F.substring("pattern", 1, 1).isin(BEFORE, AFTER, AROUND))
    wanted = written(lexical.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("pattern"), "wanted")
    passes, parts = -(-wanted.count() // most), []
    for k in range(passes):
        by_words: dict[tuple[str, ...], list[str]] = {}
        for r in wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == k).toLocalIterator():
            by_words.setdefault(words_of(r.pattern), []).append(r.pattern)
        shared = spark.sparkContext.broadcast(by_words)

        def run(batches, shared=shared):
            forget()
            of = shared.value
            ones, pairs, total = {x[0] for x in of if len(x) == 1}, {x for x in of if len(x) == 2}, Counter()
            heads = {x[0] for x in pairs}
            for batch in batches:
                for t in texts(batch.column(0)):
                    total.update(occurrences(t, ones, pairs, heads))
            found = [(p, n) for x, n in total.items() for p in of[x]]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["pattern", "n"])

        parts.append(docs.select(text).mapInArrow(run, "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")))
    none = spark.createDataFrame([], "pattern string, n bigint")
    return written(functools.reduce(DataFrame.unionByName, parts, none), "measures")


def discovered(seen: DataFrame, edges: DataFrame, measures: DataFrame, *, confidence: float = 0.5, least: float = 0.25, rounds: int = 3, support: float = 3.0) -> DataFrame:
    """(content, start, end, score) of candidates that are identifiers, from what ``contexts_of`` and ``measured`` give.

    ``score`` is the best lexical pattern's confidence, or its mean with the better of shape and outline if that is
    more; a candidate whose best lexical pattern is below ``least`` has none.
    """
    sure = written(score_patterns(edges, measures, rounds=rounds, support=support).where(F.col("confidence") > 0), "patterns")
    # A hot pattern may hold a third of the candidates.
    hot = hot_keys(edges.groupBy("pattern").agg(F.sum("n").alias("n")), "pattern", "n")
    open_ones = split_join(seen.where("not seed").select("content", "start", "end", F.explode("patterns").alias("pattern")), sure, "pattern", hot)
    best = lambda *families: F.coalesce(F.max(F.when(F.substring("pattern", 1, 1).isin(*families), F.col("confidence"))), F.lit(0.0))
    found = open_ones.groupBy("content", "start", "end").agg(best(BEFORE, AFTER, AROUND).alias("words"), best(SHAPE, OUTLINE).alias("form"))
    scored = found.where(F.col("words") >= least).select("content", "start", "end", F.greatest("words", (F.col("words") + F.col("form")) / 2).alias("score"))
    return scored.where(F.col("score") >= confidence)


def contexts_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of what ``extracted`` gave (written): occurrences (content, instance, patterns, seed, start, end, n; n equal texts have it), and edges (pattern, instance, seed, n)."""
    each = rows.where(F.size("contexts") > 0).select("content", F.explode("contexts").alias("c")).select("content", "c.*")
    seen = written(each.groupBy("content", "start", "end").agg(*[F.first(c).alias(c) for c in ("instance", "patterns", "seed")], F.count("*").alias("n")), "contexts")
    edges = seen.select("instance", "seed", "n", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.sum("n").alias("n"))
    return seen, written(edges, "edges")


def detect(docs: DataFrame, *, id: str = "doc_id", text: str = "text", confidence: float = 0.5, rounds: int = 3) -> DataFrame:
    """(id, content, base, spans) for each row of ``docs``: base spans, and all spans, in order.

    Kinds are numbered as in KINDS; the next number is what contexts discovered. Null and empty
    texts have no spans; repeated rows have the same; an empty table gives no rows. Further
    columns are ignored, whatever they are called.
    """
    rows = written(extracted(docs, id=id, text=text), "extracted")
    seen, edges = contexts_of(rows)
    found = discovered(seen, edges, measured(docs, edges, text=text), confidence=confidence, rounds=rounds)
    more = found.groupBy(F.col("content").alias("of")).agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")).alias("more"))
    more = bounded(written(more, "discovered"))
    out = rows.join(more, F.col("content") == F.col("of"), "left")
    return out.select("id", "content", "base", F.array_sort(F.concat("base", F.coalesce(F.col("more"), F.array().cast(_SPAN_SQL)))).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in [*KINDS, FOUND]])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def masked(text: str | None, spans: list) -> str | None:
    """The text with each span replaced by its kind in square brackets; overlapping spans are one, of the first's kind."""
    if text is None or not spans:
        return text
    out, last = [], 0
    names = [k.upper() for k in [*KINDS, FOUND]]
    groups: list[list[int]] = []
    for start, kind, end in sorted(spans):
        if groups and start < groups[-1][2]:
            groups[-1][2] = max(groups[-1][2], end)
        else:
            groups.append([start, kind, end])
    for start, kind, end in groups:
        out += [text[last:start], f"[{names[kind]}]"]
        last = end
    return "".join([*out, text[last:]])


def redacted(docs: DataFrame, *, id: str = "doc_id", text: str = "text", confidence: float = 0.5, n_chars: str | None = None) -> DataFrame:
    """``docs`` with personal data masked in ``text`` (and its new length in ``n_chars``, if named). No row is dropped.

    Only texts with spans are joined and rewritten. A caller's columns are kept, whatever they are called.
    """
    found = detect(docs, id=id, text=text, confidence=confidence).where(F.size("spans") > 0)
    key, of, into = (free_name(docs, n) for n in ("__content", "__of", "__spans"))
    found = bounded(written(found.groupBy(F.col("content").alias(of)).agg(F.first("spans").alias(into)), "spans"))
    kept, schema = docs.columns, docs.schema
    joined = docs.withColumn(key, content_of(text)).join(found, F.col(key) == F.col(of), "left").drop(key, of)

    def run(batches):
        forget()
        for batch in batches:
            names = batch.schema.names
            new = [masked(t, [(s["start"], s["kind"], s["end"]) for s in spans or []]) for t, spans in zip(batch.column(names.index(text)).to_pylist(), batch.column(names.index(into)).to_pylist(), strict=True)]
            columns = []
            for c in kept:
                if c == text:
                    columns.append(pa.array(new, pa.string()))
                elif c == n_chars:
                    columns.append(pa.array([None if t is None else len(t) for t in new], batch.column(names.index(c)).type))
                else:
                    columns.append(batch.column(names.index(c)))
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    return joined.mapInArrow(run, schema)
