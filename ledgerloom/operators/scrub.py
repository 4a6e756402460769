"""Redaction by typed patterns with confidences: detection, overlap resolution and masking in one Arrow pass."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import short_batches

# Patterns by type, in the order in which ties are resolved.
PATTERNS = [
    ("EMAIL", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE", r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("PHONE", r"\b\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}\b"),
    ("SSN", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b"),
    ("CREDIT_CARD", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"),
    ("CREDIT_CARD", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    ("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b"),
    ("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"),
    ("IP_ADDRESS", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    ("MAC_ADDRESS", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"),
    ("DATE_OF_BIRTH", r"\b(?:0[1-9]|1[0-2])[/.-](?:0[1-9]|[12]\d|3[01])[/.-](?:19|20)\d{2}\b"),
    ("DATE_OF_BIRTH", r"\b(?:19|20)\d{2}[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])\b"),
    ("PASSPORT", r"\b[A-Z]{1,2}\d{6,9}\b"),
]
# Types that only count where they are asked for, cues before a value, ways to redact.
MORE_PATTERNS = [("ROUTING_NUMBER", r"\b\d{9}\b"), ("BANK_ACCOUNT", r"\b\d{8,17}\b")]
CUES = {"SSN": r"(?i)(?:ssn|social\s*security)", "DATE_OF_BIRTH": r"(?i)(?:dob|date\s*of\s*birth|born|birthday)"}
STYLES = ["mask", "hash", "placeholder", "remove"]


def detect(text: str, compiled, cues) -> list[tuple[int, int, float, str]]:
    """(start, end, confidence, type): 0.8 for a pattern, 0.95 within 100 characters after a cue; overlaps resolved.

    Sorted by start, then falling confidence, then declared order; of overlapping spans the first
    stays unless a later one has a higher confidence.
    """
    found = []
    for order, (kind, pattern) in enumerate(compiled):
        for m in pattern.finditer(text):
            sure = kind in cues and any(c.end() <= m.start() <= c.end() + 100 for c in cues[kind].finditer(text, max(0, m.start() - 160), m.start()))
            found.append((m.start(), -0.95 if sure else -0.8, order, m.end(), kind))
    out: list[tuple[int, int, float, str]] = []
    for start, confidence, _, end, kind in sorted(found):
        if out and start < out[-1][1]:
            if -confidence > out[-1][2]:
                out[-1] = (start, end, -confidence, kind)
        else:
            out.append((start, end, -confidence, kind))
    return out


def merged(spans: list[tuple[int, int, float, str]]) -> list[tuple[int, int, float, str]]:
    """Spans that overlap or touch as one: of the higher confidence, else of the first one's type and up to the later end."""
    out: list[tuple[int, int, float, str]] = []
    for span in spans:
        if out and span[0] <= out[-1][1]:
            last = out[-1]
            if span[2] > last[2]:
                out[-1] = span
            elif span[1] > last[1]:
                out[-1] = (last[0], span[1], last[2], last[3])
        else:
            out.append(span)
    return out


def redact(value: str, kind: str, style: str, masks: dict[str, str] | None = None) -> str:
    if masks and kind in masks:
        return masks[kind]
    if style == "hash":
        return f"[{kind}_{hashlib.md5(value.encode()).hexdigest()[:8]}]"
    return {"mask": f"[{kind}]", "placeholder": "XXXXX", "remove": ""}[style]


def scrub(df: DataFrame, id: str, text: str, *, style: str = "mask", least: float = 0.7, types: list[str] | None = None, masks: dict[str, str] | None = None, skip: Column | None = None) -> DataFrame:
    """(id, text, pii_count, pii_types): redacted texts; nulls stay null. Texts without a digit or an at sign aren't searched.

    ``types`` chooses among all types (the nine usual ones, if not given); ``masks`` replaces some types by texts of
    one's own; rows of which ``skip`` is true pass as they are.
    """
    wanted = [(k, p) for k, p in [*PATTERNS, *MORE_PATTERNS] if (k in types if types is not None else k not in dict(MORE_PATTERNS))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(k, re.compile(p)) for k, p in wanted]
        cues = {k: re.compile(p) for k, p in CUES.items()}
        maybe = re.compile("[0-9@]")
        for pdf in batches:
            texts, counts, types = [], [], []
            for t, passed in zip(pdf[text], pdf["__skip"], strict=True):
                spans = merged([s for s in detect(t, compiled, cues) if s[2] >= least]) if t and not passed and maybe.search(t) else []
                parts, last = [], 0
                for start, end, _, kind in spans:
                    parts += [t[last:start], redact(t[start:end], kind, style, masks)]
                    last = end
                texts.append("".join([*parts, t[last:]]) if spans else t)
                counts.append(len(spans))
                types.append(sorted({s[3] for s in spans}))
            yield pd.DataFrame({id: pdf[id], text: texts, "pii_count": counts, "pii_types": types})

    short_batches(df.sparkSession)
    passed = F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False)
    return df.select(F.col(id).cast("long"), text, passed.alias("__skip")).mapInPandas(run, f"{id} bigint, {text} string, pii_count int, pii_types array<string>")


def stats(scrubbed: DataFrame) -> DataFrame:
    """(type, samples): how many samples have each type, in all, and any."""
    each = scrubbed.select(F.explode(F.concat(F.array(F.lit("ALL")), F.when(F.col("pii_count") > 0, F.array(F.lit("ANY"))).otherwise(F.array().cast("array<string>")), "pii_types")).alias("type"))
    return each.groupBy("type").agg(F.count("*").alias("samples"))
