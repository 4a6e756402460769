"""Fill-in-the-middle: every text is cut at two drawn places and its parts are put in another order.

The cuts of all rows of an Arrow batch are found together, in numpy, on the batch's UTF-8 buffer: a table gives each
byte its class, a second table says for each pair of adjacent classes whether a unit starts between them, a cumulative
sum of that mask (from which each document's value at its start is taken off) numbers the units, and one ``searchsorted``
in it turns the drawn unit numbers of all rows into byte positions. No text is decoded. What is drawn depends on the
seed and the id only, so a lost task gives the same rows again. There is no shuffle.

Scratch is about six bytes for each byte of a batch (or of a single longer text).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.shared import free_name, utf8

#: Order of the parts in each form; a mark stands before each part.
ORDER = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}


@dataclass(frozen=True)
class Marks:
    """What stands before each part. A mark may not share bytes with another one that stands beside it, so that parts can be told apart again."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        all_marks = [m.encode() for m in (self.prefix, self.suffix, self.middle)]
        if len(set(all_marks)) < 3 or not all(all_marks):
            raise ValueError("three different marks are needed")
        for a, b in itertools.product(all_marks, repeat=2):
            if any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))) or (a != b and a in b):
                raise ValueError(f"marks overlap: {a!r}, {b!r}")


def _units() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each kind of unit: the class of every byte, and whether a unit starts between two classes."""
    byte = np.arange(256)
    word = ((byte >= 48) & (byte <= 57)) | ((byte | 32) >= 97) & ((byte | 32) <= 122) & (byte < 128) | (byte >= 128)
    space = np.isin(byte, np.frombuffer(b" \t\n\v\f\r", np.uint8))
    return {
        "char": (((byte & 0xC0) != 0x80).astype(np.uint8), np.array([[False, True], [False, True]])),
        "word": (np.where(space, 0, np.where(word, 1, 2)).astype(np.uint8), np.array([[False, True, True], [True, False, True], [True, True, True]])),
        "line": ((byte != 10).astype(np.uint8), np.array([[True, True], [False, False]])),
    }


UNITS = _units()


def unit_ends(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """The running number of units that start up to each byte, over all documents, and its value before each document and behind the last."""
    classes, starts = UNITS[unit]
    kind = classes[data]
    mask = np.empty(len(data), bool)
    mask[1:] = starts.ravel()[kind[:-1] * np.uint8(len(starts)) + kind[1:]]
    first = offsets[:-1][np.diff(offsets) > 0]
    mask[first] = True
    running = np.cumsum(mask, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    return running, np.where(offsets > 0, running[np.maximum(offsets, 1) - 1] if len(data) else 0, 0).astype(np.int64)


def find_mark(data: np.ndarray, offsets: np.ndarray, mark: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Rows and byte positions of a mark, wherever a document holds all of it."""
    at = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
    for k in range(1, len(mark)):
        at = at[data[at + k] == mark[k]]
    row = np.searchsorted(offsets, at, "right") - 1
    whole = at + len(mark) <= offsets[row + 1]
    return row[whole], at[whole]


def cuts(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, unit: str = "char") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each row, the lower and upper unit number drawn (2 x rows), and their byte positions (2 x rows). ``draws``: two unsigned integers a row (2 x rows)."""
    running, base = unit_ends(data, offsets, unit)
    n = np.diff(base)
    chosen = np.sort(draws % (n + 1), axis=0)
    at = np.searchsorted(running, (base[:-1] + chosen + 1).ravel(), "left").reshape(chosen.shape)
    return n, chosen, np.minimum(at, offsets[1:])


def _strings(pieces: list, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    wide = offsets[-1] >= 1 << 31
    kind = pa.large_string() if wide else pa.string()
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(offsets.astype(np.int64 if wide else np.int32)), pa.py_buffer(b"".join(pieces))])


def formed(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, spm: np.ndarray, plain: np.ndarray, marks: Marks, unit: str) -> dict[str, np.ndarray | pa.Array]:
    """The columns of a batch. ``spm`` and ``plain``: what is drawn for each row; a row is also plain if it is empty or holds a mark."""
    n, chosen, at = cuts(data, offsets, draws, unit)
    plain = plain | (np.diff(offsets) == 0)
    encoded = {k: getattr(marks, k).encode() for k in ("prefix", "suffix", "middle")}
    for mark in encoded.values():
        plain[find_mark(data, offsets, mark)[0]] = True
    chars = chosen
    if unit != "char":
        running, base = unit_ends(data, offsets, "char")
        chars = np.where(at > 0, running[np.maximum(at, 1) - 1] if len(data) else 0, 0) - base[:-1]
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    view, pieces = memoryview(data), []
    for kind, start, lower, upper, end in zip(form.tolist(), offsets[:-1].tolist(), at[0].tolist(), at[1].tolist(), offsets[1:].tolist(), strict=True):
        if kind == "plain":
            pieces.append(view[start:end])
            continue
        part = {"prefix": view[start:lower], "middle": view[lower:upper], "suffix": view[upper:end]}
        for name in ORDER[kind]:
            pieces += encoded[name], part[name]
    lengths = np.diff(offsets) + np.where(plain, 0, sum(map(len, encoded.values())))
    return {"n": n, "form": form, "plain": plain, "prefix_chars": chars[0], "middle_chars": chars[1] - chars[0], "output": _strings(pieces, lengths)}


def rebuilt(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, marks: Marks) -> pa.Array:
    """The texts that the outputs were made of; a ValueError where an output doesn't hold each mark once."""
    rows, place, size = len(form), {}, {}
    for name in ("prefix", "suffix", "middle"):
        mark = getattr(marks, name).encode()
        row, at = find_mark(data, offsets, mark)
        if not np.array_equal(np.bincount(row, minlength=rows)[form != "plain"], np.ones((form != "plain").sum())):
            raise ValueError(f"an output doesn't hold {mark!r} once")
        place[name], size[name] = np.zeros(rows, np.int64), len(mark)
        place[name][row] = at
    view, pieces = memoryview(data), []
    lengths = np.diff(offsets) - np.where(form == "plain", 0, sum(size.values()))
    for k, kind in enumerate(form.tolist()):
        if kind == "plain":
            pieces.append(view[offsets[k] : offsets[k + 1]])
            continue
        order = ORDER[kind]
        ends = {a: place[b][k] for a, b in itertools.pairwise(order)} | {order[-1]: offsets[k + 1]}
        pieces += [view[place[name][k] + size[name] : ends[name]] for name in ("prefix", "middle", "suffix")]
    return _strings(pieces, lengths)


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, *, id: str = "doc_id", text: str = "text", seed: int = 1, unit: str = "char", percent: int = 90, spm_percent: int = 20, marks: Marks = Marks()) -> DataFrame:
    """Per row of ``docs``: the id, n (units), form, prefix_chars and middle_chars (code points; null if plain), output.

    ``unit``: "char" (code points), "word" (runs of spaces, of letters and digits, and single signs) or "line". ``percent`` of
    the texts are cut, ``spm_percent`` of those have the suffix first. Null and empty texts, and those that hold a mark, are plain; a
    null id draws like an empty one, equal ids draw alike. Repeated rows are kept. Other columns are ignored, whatever they are called.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    drawn = docs.select(F.col(id), F.col(text).cast("string"), *[_draw(digest, k).alias(f"h{k}") for k in range(4)])
    schema = T.StructType([T.StructField(id, docs.schema[id].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            h1, h2, h3, h4 = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6))
            out = formed(data, offsets, np.stack([h1, h2]), h4 % 100 < spm_percent, h3 % 100 >= percent, marks, unit)
            of_parts = [pa.array(out[k], pa.int64(), mask=out["plain"]) for k in ("prefix_chars", "middle_chars")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["form"].tolist(), pa.string()), *of_parts, out["output"]], names=schema.names)

    return drawn.mapInArrow(run, schema)


def restored(rows: DataFrame, *, output: str = "output", form: str = "form", into: str = "restored", marks: Marks = Marks()) -> DataFrame:
    """``rows`` and the text rebuilt from output and form, in a column ``into`` (with underscores where that name is taken). A null output is an empty text."""
    into = free_name(rows, into)
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())])
    at, kind = rows.columns.index(output), rows.columns.index(form)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            text = rebuilt(data, offsets, np.array(batch.column(kind).to_pylist(), object), marks)
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=schema.names)

    return rows.mapInArrow(run, schema)
