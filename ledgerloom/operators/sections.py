"""Sections and chunks of texts as table functions: a text is read once, line by line, and gives a row a part."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headers of sections; the group is the title.
HEADERS = [
    r"^(?:CHAPTER|Chapter)\s+\d+[:\.]?\s*(.+)$",
    r"^(?:SECTION|Section)\s+\d+[:\.]?\s*(.+)$",
    r"^(?:\d+\.)+\s+(.+)$",
    r"^(?:ANNEX|Annex)\s+\w+[:\.]?\s*(.+)$",
    r"^(?:APPENDIX|Appendix)\s+\w+[:\.]?\s*(.+)$",
    r"^Case\s+(?:Study|Example)\s*\d*[:\.]?\s*(.*)$",
    r"^(?:Box|Figure|Table)\s+\d+[:\.]?\s*(.+)$",
]


def header_title(line: str, headers: list[re.Pattern]) -> str | None:
    """The title if the (trimmed) line is a header: of one of the seven kinds, or all in capitals with 11 to 99 characters; else None."""
    for h in headers:
        if found := h.match(line):
            return found[1] or line
    return line if 10 < len(line) < 100 and line.isupper() else None


class Sections:
    """SELECT ... FROM t, LATERAL text_sections(t.text): section, title, content."""

    def __init__(self):
        self.headers = [re.compile(h, re.IGNORECASE) for h in HEADERS]

    def eval(self, text: str) -> Iterator[tuple]:
        number, title, lines = 0, "Introduction", []
        for line in (text or "").split("\n"):
            line = line.strip()
            new = header_title(line, self.headers) if line else None
            if new is None:
                lines.append(line)
                continue
            yield number, title, "\n".join(lines).strip()
            number, title, lines = number + 1, new, []
        yield number, title, "\n".join(lines).strip()


class Chunks:
    """SELECT ... FROM t, LATERAL text_chunks(t.text, 512, 64): chunk_index, chunk, of whole words, the last words of each again in the next."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        if size <= overlap or overlap < 0:
            raise ValueError("a chunk is longer than what it shares with the next one")
        words, index = (text or "").split(), 0
        for start in range(0, max(len(words) - overlap, 1), size - overlap):
            yield index, " ".join(words[start : start + size])
            index += 1


#: Table functions for DataFrames, and for SQL once ``register`` was called.
text_sections = F.udtf(Sections, returnType="section int, title string, content string")
text_chunks = F.udtf(Chunks, returnType="chunk_index int, chunk string")


def register(spark) -> None:
    """Make text_sections and text_chunks known to SQL."""
    spark.udtf.register("text_sections", text_sections)
    spark.udtf.register("text_chunks", text_chunks)


def titled_sections(df: DataFrame, id: str, text: str, least: int = 100) -> DataFrame:
    """(id, section, title, content): a header line starts a section, titled by its own words ("Introduction" before the first).

    Lines are trimmed; contents, trimmed too, of ``least`` characters or fewer are dropped. A text is read once, in time that grows with its
    length, in its own row: no text's lines are sorted or gathered by a shuffle.
    """
    rows = df.select(F.col(id).alias("__key"), F.col(text).cast("string").alias("__text"))
    parts = rows.lateralJoin(text_sections(F.col("__text").outer()))
    return parts.where(F.length("content") > least).select(F.col("__key").alias(id), "section", "title", "content")


def chunked(df: DataFrame, id: str, text: Column, size: int = 512, overlap: int = 64) -> DataFrame:
    """(id, chunk_index, chunk) of ``size`` words, ``overlap`` of them shared with the next chunk; one of an empty text."""
    rows = df.select(F.col(id).alias("__key"), text.alias("__text"))
    return rows.lateralJoin(text_chunks(F.col("__text").outer(), F.lit(size), F.lit(overlap))).select(F.col("__key").alias(id), "chunk_index", "chunk")
