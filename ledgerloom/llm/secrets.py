"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by its content. The ledger is a table in shared storage that
tells which blob was scanned by which version of which rule, and what was found. A run compares
digests with it first; only texts of blobs that some rule version has not seen are scanned, by
those rules alone. Texts are scanned where they are read, and only spans move, by blob. Findings
are joined back to all paths.

Offsets come from pairing ``split`` with ``regexp_extract_all``: the lengths of what stands
between matches and of the matches themselves add up to where each match starts.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import bounded, free_name, new_folder, written

#: Kind, pattern, group whose length counts, least length. In the order in which kinds are listed.
BASE_RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
#: Further kinds that the ledger looks for: key headers, web tokens and tokens with a known prefix.
MORE_RULES = [
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("prefixed", r"(?:ghp_|gho_|glpat-|xox[abpr]-|sk_live_)[A-Za-z0-9_-]{16,}", 0, 1),
]
#: For some kinds, lower-case texts of which each match holds one: they are sought before the pattern is. Other kinds are always sought.
LITERALS = {
    "assign": ["passw", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "pem": ["-----begin "],
    "jwt": ["eyj"],
    "prefixed": ["ghp_", "gho_", "glpat-", "xox", "sk_live_"],
}
#: A rule's version, 1 if it is not listed: raise it with every change of the rule, and all blobs are scanned anew by that rule.
VERSIONS: dict[str, int] = {}

_SPANS_SQL = "array<struct<start:int,kind:int,end:int>>"
_LEDGER_SQL = "blob string, rules array<string>, spans array<struct<start:int,rule:string,end:int>>"


def may_match(low: Column, rule: tuple) -> Column:
    """Whether a text (in lower case) holds what every match of a rule as listed here holds; true for a rule of the caller's own."""
    known = rule in BASE_RULES or rule in MORE_RULES
    return functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in LITERALS[rule[0]]]) if known and rule[0] in LITERALS else F.lit(True)


def rule_key(rule: tuple, versions: dict[str, int] | None = None) -> str:
    return f"{rule[0]}@{(versions or VERSIONS).get(rule[0], 1)}"


def spans_of(text: Column, kind_no: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, end>> of the leftmost non-overlapping matches, code points, end exclusive; too short ones dropped.

    ``access`` and ``hex`` bound their length in the pattern, which finds the same spans there: a
    failing run has no longer run inside it. ``assign`` must consume its failing matches, so its
    lengths are compared afterwards.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = [F.split(text, pattern, -1).alias("g"), found.alias("m")]
    if group:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("s"))
    counted = "s" if group else "m"

    def fold(bound: Column) -> Column:
        return F.aggregate(
            F.arrays_zip(*[bound[p].alias(p) for p in ("g", "m", "s")[: len(parts)]]),
            F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
                F.when(
                    x["m"].isNotNull() & (F.length(x[counted]) >= least),
                    F.concat(
                        acc["out"],
                        F.array(F.struct((acc["at"] + F.length(x["g"])).alias("start"), F.lit(kind_no).alias("kind"), (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("end"))),
                    ),
                )
                .otherwise(acc["out"])
                .alias("out"),
            ),
            lambda acc: acc["out"],
        )

    # A one-element array binds the parts, so that each pattern is matched once for each of them.
    spans = F.transform(F.array(F.struct(*parts)), fold)[0]
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], _LEDGER_SQL)


def ledger_at(spark: SparkSession, path: str) -> DataFrame:
    """The ledger kept in a folder; an empty one where there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(_LEDGER_SQL).parquet(path) if known else empty_ledger(spark)


def blob_of(text: str) -> Column:
    """The digest of a text; null is the empty text."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def scan(versions: DataFrame, ledger: DataFrame | None = None, *, text: str = "text", rules: list[tuple] | None = None, rule_versions: dict[str, int] | None = None) -> DataFrame:
    """New ledger rows (blob, rules, spans): for each blob of ``versions``, the rule versions that ``ledger`` lacks and what they find.

    Only digests are compared with the ledger; texts that it has in full are not read again. Copies that are
    in several tasks are scanned by each, and one result is kept. Null texts are empty; other
    columns are ignored, whatever they are called; an empty table gives no rows.
    """
    rules = rules or [*BASE_RULES, *MORE_RULES]
    keys = [rule_key(r, rule_versions) for r in rules]
    texts = versions.select(blob_of(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    every = F.array(*map(F.lit, keys))
    if ledger is None or ledger.isEmpty():
        texts = texts.withColumn("missing", every)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        missing = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
        unseen = versions.select(blob_of(text).alias("blob")).distinct().join(seen, "blob", "left").select("blob", missing.alias("missing")).where(F.size("missing") > 0)
        texts = texts.join(bounded(written(unseen, "unseen")), "blob")
    none = F.array().cast("array<struct<start:int,rule:string,end:int>>")

    texts = texts.withColumn("low", F.lower("text"))

    def by(key: str, k: int, rule: tuple) -> Column:
        spans = F.transform(spans_of(F.col("text"), k, *rule[1:]), lambda s: F.struct(s["start"].alias("start"), F.lit(key).alias("rule"), s["end"].alias("end")))
        return F.when(F.array_contains("missing", key) & may_match(F.col("low"), rule), spans).otherwise(none)

    each = [by(key, k, rule) for k, (key, rule) in enumerate(zip(keys, rules, strict=True))]
    # Equal blobs lack and hold the same, so whole rows are compared: a hash aggregate, without a sort.
    return texts.select("blob", F.col("missing").alias("rules"), F.flatten(F.array(*each)).alias("spans")).distinct()


def update(versions: DataFrame, path: str, *, text: str = "text", rules: list[tuple] | None = None, rule_versions: dict[str, int] | None = None) -> DataFrame:
    """The ledger in the folder ``path`` once all of ``versions`` are in it; new rows are appended, and it is read back.

    Two runs on one ledger at once may both append a blob's row; ``findings`` counts equal spans once.
    """
    spark = versions.sparkSession
    new = scan(versions, ledger_at(spark, path), text=text, rules=rules, rule_versions=rule_versions)
    new.write.mode("append").parquet(path)
    return ledger_at(spark, path)


def joined_spans(spans: Column, rules: list[tuple] | None = None) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(r[0]) for r in rules or [*BASE_RULES, *MORE_RULES]])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def findings(versions: DataFrame, ledger: DataFrame, *, text: str = "text", rules: list[tuple] | None = None, rule_versions: dict[str, int] | None = None) -> DataFrame:
    """Every row of ``versions`` (all its columns but the text) with the digest and the spans of its blob, from the ledger.

    The new columns are called ``blob`` and ``spans``, with underscores after them where ``versions`` has such
    columns itself. Spans are of the rule versions asked for, by start, then kind; kinds are numbered as the
    rules. Only blobs with a finding are joined, by broadcast as long as they are few; else the join
    can be split where a third of all rows share a blob.
    """
    rules = rules or [*BASE_RULES, *MORE_RULES]
    keys = F.array(*[F.lit(rule_key(r, rule_versions)) for r in rules])
    current = F.filter("spans", lambda s: F.array_contains(keys, s["rule"]))
    numbered = F.transform(current, lambda s: F.struct(s["start"].alias("start"), (F.array_position(keys, s["rule"]) - 1).cast("int").alias("kind"), s["end"].alias("end")))
    of, into = free_name(versions, "__blob"), free_name(versions, "__found")
    hits = ledger.where(F.size("spans") > 0).select(F.col("blob").alias(of), numbered.alias("s")).where(F.size("s") > 0)
    hits = bounded(written(hits.groupBy(of).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias(into)), "hits"))
    blob, spans = free_name(versions, "blob"), free_name(versions, "spans")
    paths = versions.select(*[F.col(f"`{c}`") for c in versions.columns if c != text], blob_of(text).alias(blob))
    out = paths.join(hits, F.col(f"`{blob}`") == F.col(of), "left")
    return out.select(*[F.col(f"`{c}`") for c in paths.columns], F.coalesce(into, F.array().cast(_SPANS_SQL)).alias(spans))


def scan_paths(versions: DataFrame, *, text: str = "text", ledger: str | None = None) -> DataFrame:
    """Findings of all rows, after the ledger in the folder ``ledger`` (a new one if not given) was brought up to date.

    Null texts are empty and have no findings; repeated rows and null keys each give a row; an
    empty table gives no rows.
    """
    at = ledger or new_folder(versions.sparkSession, "ledger")
    return findings(versions, update(versions, at, text=text), text=text)
