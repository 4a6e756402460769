"""SentencePiece encoding and decoding, with a max-plus scan for giant documents.

A BPE encoding is the one path through a text's pieces in which every two neighbours are what BPE
makes of their joined text. Put as a max-plus problem: a path through the lattice of pieces has
weight 0 if all its neighbours agree and minus infinity otherwise. That makes it associative: a
giant text is cut anywhere into chunks; each chunk yields a matrix of weights from the states
at its start (which piece lies across or ends at the cut) to those at its end; matrices combine by
(max, +) products, first within blocks of chunks, then over blocks; once the states at the
blocks' ends are known, each block finds those at its cuts, and each chunk traces its own pieces
back. The result equals what the library makes of the whole text.

Where no piece spans two neighbouring characters, every path passes between them. If the model
has no piece with a space mark after another character, that is so before each word; a chunk's
matrix then only depends on what stands before its first word and behind its last one, and the
pieces of whole words between are remembered.

Texts up to ``giant`` code points are encoded whole by the library; so is a text whose scan does
not end in exactly one path. The column ``path`` says which it was.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import REMEMBERED, bounded, texts, written

#: Code points from which a text is scanned, code points a chunk, and chunks a block.
GIANT, CHUNK, BLOCK = 16_384, 4_096, 64
SPACE = "▁"
#: A state: the piece's id, and its start relative to the cut (0 or below; the start of the text has id -1).
State = tuple[int, int]
Matrix = dict[State, dict[State, float]]
START: State = (-1, 0)
_WORD_START = re.compile(f"(?<=[^{SPACE}]){SPACE}")
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Pieces:
    """The pieces of a model, their scores, and which neighbours agree."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        p, n = self.processor, self.processor.get_piece_size()
        self.byte = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
        plain = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.id_of = {p.id_to_piece(i): i for i in plain}
        self.score = {i: p.get_score(i) for i in plain}
        self.text_of = {i: s for s, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        self.raw = [b""] * n
        for i in plain:
            self.raw[i] = self.text_of[i].replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self._agree: dict[tuple[int, int], bool] = {}
        self._words: dict[str, list[int]] = {}
        #: Whether every path passes between a character and a space mark after it.
        self.by_words = not any(SPACE in piece.lstrip(SPACE) for piece in self.id_of)

    def merged(self, text: str) -> list[str]:
        """What BPE makes of a short text: the best pair of neighbours is merged, the leftmost of equals, until there is none."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.id_of.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def agree(self, a: int, b: int) -> bool:
        """Unknown code points (ids below -1) agree with everything; the start of the text with what BPE makes of itself."""
        if a < -1 or b < 0:
            return True
        found = self._agree.get((a, b))
        if found is None:
            if len(self._agree) > 2_000_000:
                self._agree.clear()
            x, y = self.text_of.get(a, ""), self.text_of[b]
            found = self._agree[a, b] = self.merged(x + y) == ([x, y] if x else [y])
        return found

    def starting(self, text: str, at: int) -> list[tuple[int, int]]:
        """(id, end) of the pieces that start at a position; an unknown code point is its own piece, with an id below -1."""
        out = []
        for end in range(at + 1, min(at + self.longest, len(text)) + 1):
            i = self.id_of.get(text[at:end])
            if i is not None:
                out.append((i, end))
        if not out or out[0][1] != at + 1:
            out.append((-2 - ord(text[at]), at + 1))
        return out

    def word_cuts(self, text: str, start: int, stop: int) -> tuple[int, int] | None:
        """The first and the last position from ``start`` and before ``stop`` where a word begins after another character."""
        if not self.by_words:
            return None
        first = _WORD_START.search(text, start, stop)
        if not first:
            return None
        last = text.rfind(SPACE, start, stop)
        while text[last - 1] == SPACE:
            last -= 1
        return first.start(), max(first.start(), last)

    def word(self, text: str) -> list[int]:
        """The pieces of a text between two cuts that every path passes, by the lattice of that text alone."""
        found = self._words.get(text)
        if found is None:
            if len(self._words) > 500_000:
                self._words.clear()
            found = _path(self, text, 0, len(text), START, None)
            if len(text) <= 64:
                self._words[text] = found
        return found

    def output(self, i: int) -> list[int]:
        return [i] if i >= 0 else [self.byte[b] for b in chr(-2 - i).encode("utf-8", "surrogatepass")]


def _forward(pieces: Pieces, text: str, start: int, stop: int, entries: list[State], keep: bool):
    """Last pieces at every position from each entry: a list of (entries, position -> (id, start)).

    ``text`` holds the chunk [start, stop) and its surroundings. Entries that come to agree are
    followed as one; ``keep`` retains all positions for a trace.
    """
    threads = [([e], {start + e[1] + piece_length(pieces, e): (e[0], start + e[1])}) for e in entries]
    for at in range(start, stop):
        following = None
        for _, last in threads:
            held = last.get(at)
            if held is None:
                continue
            following = following if following is not None else pieces.starting(text, at)
            for i, end in following:
                if pieces.agree(held[0], i):
                    last[end] = (i, at)
        if len(threads) > 1 and at % 16 == 15:
            threads = _merged_threads(threads, at + 1, pieces.longest, keep)
    return threads


def piece_length(pieces: Pieces, state: State) -> int:
    return len(pieces.text_of[state[0]]) if state[0] >= 0 else (0 if state[0] == -1 else 1)


def _merged_threads(threads, at: int, longest: int, keep: bool):
    """Threads whose last pieces agree from here on are one; threads without any are gone."""
    seen: dict[tuple, tuple] = {}
    for entries, last in threads:
        ahead = tuple((p, last.get(p)) for p in range(at, at + longest) if p in last)
        if not ahead:
            continue
        if ahead in seen and not keep:
            seen[ahead][0].extend(entries)
        else:
            seen[(ahead, len(seen)) if ahead in seen else ahead] = (entries, last if keep else {p: x for p, x in last.items() if p >= at})
    return list(seen.values())


def entries_at(pieces: Pieces, text: str, cut: int) -> list[State]:
    """Pieces that start before a cut and end at it or behind; at the start of the text, its one start state."""
    if cut == 0:
        return [(-1, 0)]
    out = []
    for start in range(max(0, cut - pieces.longest), cut):
        out += [(i, start - cut) for i, end in pieces.starting(text, start) if end >= cut]
    return out


def transfer(pieces: Pieces, text: str, start: int, stop: int, last_chunk: bool) -> Matrix:
    """Weights (0; what is absent is minus infinity) from the states at ``start`` to those at ``stop``."""
    cuts = pieces.word_cuts(text, start, stop)
    if not cuts:
        threads = _forward(pieces, text, start, stop, entries_at(pieces, text, start), False)
        return {e: exits for entries, last in threads if (exits := _exits(last, stop, last_chunk)) for e in entries}
    before = _forward(pieces, text, start, cuts[0], entries_at(pieces, text, start), False)
    ((_, behind),) = _forward(pieces, text, cuts[1], stop, [START], False)
    exits = _exits(behind, stop, last_chunk)
    return {e: exits for entries, last in before if exits and cuts[0] in last for e in entries}


def _exits(last: dict[int, State], stop: int, last_chunk: bool) -> dict[State, float]:
    return {(i, at - stop): 0.0 for p, (i, at) in last.items() if p >= stop and at < stop and (p == stop or not last_chunk)}


def combined(a: Matrix, b: Matrix) -> Matrix:
    """(max, +) product."""
    out: Matrix = {}
    for e, middle in a.items():
        row: dict[State, float] = {}
        for m, w in middle.items():
            for x, v in b.get(m, {}).items():
                row[x] = max(row.get(x, float("-inf")), w + v)
        if row:
            out[e] = row
    return out


def product(matrices: list[Matrix]) -> Matrix:
    """The product of matrices in order, as a tree."""
    while len(matrices) > 1:
        matrices = [combined(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def cut_states(matrices: list[Matrix], first: State = START, last: State | None = None) -> list[State] | None:
    """The states at all cuts (both ends included) on the one path of weight 0 from ``first`` to ``last`` (any, if not given).

    None if there is not exactly one path.
    """
    ahead: list[set[State] | None] = [None] * (len(matrices) + 1)
    if last is not None:
        ahead[-1] = {last}
    for k in range(len(matrices) - 1, 0, -1):
        ahead[k] = {e for e, row in matrices[k].items() if ahead[k + 1] is None or any(x in ahead[k + 1] for x in row)}
    out = [first]
    for k, matrix in enumerate(matrices):
        ways = [x for x in matrix.get(out[-1], ()) if ahead[k + 1] is None or x in ahead[k + 1]]
        if len(ways) != 1:
            return None
        out.append(ways[0])
    return out


def _path(pieces: Pieces, text: str, start: int, stop: int, entry: State, leave: State | None) -> list[int]:
    """Pieces between an entry state at ``start`` and a state at ``stop`` (None: that which ends there)."""
    ((_, last),) = _forward(pieces, text, start, stop, [entry], True)
    origin = start + entry[1] + piece_length(pieces, entry)
    if leave is None:
        if stop == origin:
            return []
        i, at = last[stop]
    else:
        i, at = leave[0], stop + leave[1]
    out = []
    while at >= start and i != -1:
        out.append(i)
        if at == origin:
            break
        i, at = last[at]
    return out[::-1]


def traced(pieces: Pieces, text: str, start: int, stop: int, entry: State, leave: State) -> list[int]:
    """Ids of the pieces that start in the chunk, given the states at its two ends."""
    cuts = pieces.word_cuts(text, start, stop)
    if cuts:
        found = _path(pieces, text, start, cuts[0], entry, None)
        for word in _WORD.findall(text[cuts[0] : cuts[1]]):
            found += pieces.word(word)
        found += _path(pieces, text, cuts[1], stop, START, leave)
    else:
        found = _path(pieces, text, start, stop, entry, leave)
    return [x for i in found for x in ([i] if i >= 0 else pieces.output(i))]


def encode_giant(pieces: Pieces, text: str, chunk: int = CHUNK) -> list[int] | None:
    """The scan in one process, as the Spark stages below run it. None if there is not exactly one path."""
    normal = pieces.processor.normalize(text)
    bounds = _bounds(len(normal), chunk)
    states = cut_states([transfer(pieces, normal, a, b, b == len(normal)) for a, b in bounds])
    return states and [i for k, (a, b) in enumerate(bounds) for i in traced(pieces, normal, a, b, states[k], states[k + 1])]


def _bounds(n: int, chunk: int) -> list[tuple[int, int]]:
    return [(a, min(a + chunk, n)) for a in range(0, n, chunk)]


def decoded(pieces: Pieces, ids: list[int]) -> str:
    """Bytes of the pieces laid end to end; the space that encoding puts first is taken off."""
    text = b"".join([pieces.raw[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text



_IDS = pa.schema([("id", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("path", pa.string())])
_IDS_SQL = "id bigint, text string, ids array<int>, path string"
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_chars", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_()), ("path", pa.string())])
_DIGESTS_SQL = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_chars bigint, decoded_sha256 string, round_trip boolean, path string"


def encode(docs: DataFrame, model: str, *, id: str = "doc_id", text: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(id, text, ids, path): one row for each row of ``docs``; null and empty texts have no ids.

    ``model`` is a file on the driver, sent to executors whole. Texts of more than ``giant`` code points are
    scanned in chunks of ``chunk`` (path "scan"), others encoded by the library (path "library"). Repeated
    rows and null ids each give a row; a giant text is scanned once however many rows hold it. The model's
    normalisation applies (this one's only marks spaces, and puts one first); a giant text of which it
    leaves nothing has no ids. Other columns are ignored; an empty table gives no rows.
    """
    rows, shared = _rows(docs, model, id, text, giant, chunk)

    def whole(batches):
        processor = pieces_of(shared.value).processor
        for batch in batches:
            found = [np.array(processor.encode(t), np.int32) if ids is None else ids for t, ids in zip(texts(batch.column(1)), _given(batch), strict=True)]
            path = ["library" if ids is None else "scan" for ids in _given(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _IDS[2].type), pa.array(path, pa.string())], schema=_IDS)

    small, large = rows
    return small.mapInArrow(whole, _IDS_SQL).unionByName(large.mapInArrow(whole, _IDS_SQL))


def _given(batch: pa.RecordBatch) -> list:
    """Ids that the scan has found, None where there are none."""
    return [x.values.to_numpy() if x.is_valid else None for x in batch.column(2)] if batch.num_columns > 2 else [None] * batch.num_rows


def round_trips(docs: DataFrame, model: str, *, id: str = "doc_id", text: str = "text", giant: int = GIANT, chunk: int = CHUNK, give_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_chars, decoded_sha256, round_trip, path) for each row of ``docs``, and the ids if asked for.

    Encoding and decoding share a worker, so ids only leave it on demand. ``round_trip``: decoding
    gives the text back (a text that holds U+2581 itself does not come back). Rows as for ``encode``.
    """
    rows, shared = _rows(docs, model, id, text, giant, chunk)
    schema, names = (_DIGESTS.append(_IDS.field("ids")), _DIGESTS_SQL + ", ids array<int>") if give_ids else (_DIGESTS, _DIGESTS_SQL)

    def run(batches):
        pieces = pieces_of(shared.value)
        for batch in batches:
            rows = []
            for i, t, given in zip(batch.column(0).to_pylist(), texts(batch.column(1)), _given(batch), strict=True):
                ids = np.array(pieces.processor.encode(t), "<i4") if given is None else given.astype("<i4")
                back = decoded(pieces, ids.tolist())
                digests = (hashlib.sha256(x).hexdigest() for x in (ids.tobytes(), back.encode("utf-8", "surrogatepass")))
                rows.append((i, len(ids), next(digests), len(back), next(digests), back == t, "library" if given is None else "scan", ids))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    small, large = rows
    return small.mapInArrow(run, names).unionByName(large.mapInArrow(run, names))


def _rows(docs: DataFrame, model: str, id: str, text: str, giant: int, chunk: int) -> tuple:
    """Rows (id, text) up to ``giant`` code points, and giant rows (id, text, ids) by the scan; null ids where it found no one path."""
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    is_giant = F.length("text") > giant
    large = rows.where(is_giant).withColumn("key", F.md5("text"))
    scanned = _scanned(large.select("key", "text").dropDuplicates(["key"]), shared, chunk)
    return (rows.where(~is_giant), large.join(scanned, "key", "left").select("id", "text", "ids")), shared


def pieces_of(model: bytes) -> Pieces:
    """One table a worker: what neighbours agree is remembered from batch to batch, until another operator's tasks drop it."""
    key = "pieces", hash(model)
    if key not in REMEMBERED:
        REMEMBERED.clear()
        REMEMBERED[key] = Pieces(model)
    return REMEMBERED[key]


_CELL = pa.list_(pa.struct([(n, pa.int32()) for n in ("a", "b", "x", "y")]))
_CELL_SQL = "array<struct<a:int,b:int,x:int,y:int>>"


def _cells(matrix: Matrix) -> list[dict]:
    return [{"a": e[0], "b": e[1], "x": x[0], "y": x[1]} for e, row in matrix.items() for x in row]


def _matrix(cells: list[dict]) -> Matrix:
    out: Matrix = {}
    for c in cells:
        out.setdefault((c["a"], c["b"]), {})[c["x"], c["y"]] = 0.0
    return out


def _in_order(table: pa.Table, by: str) -> list[Matrix]:
    return [_matrix(cells) for _, cells in sorted(zip(table.column(by).to_pylist(), table.column("cells").to_pylist(), strict=True), key=lambda r: r[0])]


def _ends(key: str, name: str, first: int, states: list[State] | None) -> pa.Table:
    """Rows (key, number, entry, leave) of consecutive states; none if there is no one path."""
    schema = pa.schema([("key", pa.string()), (name, pa.int32()), *[(n, pa.int32()) for n in ("a", "b", "x", "y")]])
    rows = [(key, first + k, *states[k], *states[k + 1]) for k in range(len(states) - 1)] if states else []
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _scanned(large: DataFrame, shared, chunk: int) -> DataFrame:
    """(key, ids) of giant texts. Chunks are rows, dealt out by a hash; matrices meet by block, products of blocks by text.

    Texts of which nothing is left, and those without exactly one path, are missing.
    """
    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("part", pa.string())])

    def cut(batches):
        pieces = pieces_of(shared.value)
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                normal = pieces.processor.normalize(t)
                bounds = _bounds(len(normal), chunk)
                for first in range(0, len(bounds), 512):
                    rows = []
                    for k, (a, b) in enumerate(bounds[first : first + 512], first):
                        left = max(0, a - pieces.longest)
                        rows.append((key, k, len(bounds), a - left, b - left, normal[left : b + pieces.longest]))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(part)], schema=part)

    moved = part.remove(2).append(pa.field("cells", _CELL))

    def transfers(batches):
        pieces = pieces_of(shared.value)
        for batch in batches:
            out = [_cells(transfer(pieces, r["part"], r["start"], r["stop"], r["chunk"] + 1 == r["chunks"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in moved.names[:-1]], pa.array(out, _CELL)], schema=moved)

    # A number of partitions that is asked for is kept, so that a few giant texts are work for many tasks.
    dealt = large.mapInArrow(cut, "key string, chunk int, chunks int, start int, stop int, part string").repartition(parts, "key", "chunk")
    chunks = written(dealt.mapInArrow(transfers, f"key string, chunk int, start int, stop int, part string, cells {_CELL_SQL}").withColumn("block", F.floor(F.col("chunk") / BLOCK).cast("int")), "chunks")

    def multiply(table: pa.Table) -> pa.Table:
        cells = _cells(product(_in_order(table, "chunk")))
        return pa.table([table.column("key")[:1], table.column("block")[:1], pa.array([cells], _CELL)], names=["key", "block", "cells"])

    def between(table: pa.Table) -> pa.Table:
        return _ends(table.column("key")[0].as_py(), "block", 0, cut_states(_in_order(table, "block")))

    def inside(table: pa.Table) -> pa.Table:
        first, last = (tuple(table.column(c)[0].as_py() for c in pair) for pair in ("ab", "xy"))
        return _ends(table.column("key")[0].as_py(), "chunk", min(table.column("chunk").to_pylist()), cut_states(_in_order(table, "chunk"), first, last))

    ends = "a int, b int, x int, y int"
    matrices = chunks.select("key", "block", "chunk", "cells")
    blocks = matrices.groupBy("key", "block").applyInArrow(multiply, f"key string, block int, cells {_CELL_SQL}")
    outer = written(blocks.groupBy("key").applyInArrow(between, f"key string, block int, {ends}"), "blocks")
    states = bounded(written(matrices.join(outer, ["key", "block"]).groupBy("key", "block").applyInArrow(inside, f"key string, chunk int, {ends}"), "states"))
    traced_rows = pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def trace(batches):
        pieces = pieces_of(shared.value)
        for batch in batches:
            out = [np.array(traced(pieces, r["part"], r["start"], r["stop"], (r["a"], r["b"]), (r["x"], r["y"])), np.int32) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, traced_rows[2].type)], schema=traced_rows)

    found = chunks.join(states, ["key", "chunk"]).select("key", "chunk", "start", "stop", "part", "a", "b", "x", "y").mapInArrow(trace, "key string, chunk int, ids array<int>")
    in_order = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    return found.groupBy("key").agg(F.flatten(F.transform(in_order, lambda s: s["ids"])).alias("ids"))
