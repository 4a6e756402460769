"""Queries on documents, pages and action sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import corpus, minhash, sampling, sections, shingles
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import load, rounded

#: Phrases that stand in for narratives: one is put after each document.
PHRASES = [
    "Layering through a shell company and nominee accounts; no apparent business purpose.",
    "Structuring below threshold, split transactions, red flags and warning signs.",
    "The lawsuit and an SEC inquiry raise substantial doubt; going concern and material weakness.",
    "Paid for pizza, drinks and a hotel; doctor visit, poker night at the casino.",
    "Acme Holdings LLC wired funds to \"Blue Harbor\" via First National Bank, inconsistent with profile.",
    "We expect strong growth due to market demand, subject to various risks. All rights reserved.",
    "Trade-based over-invoicing and hawala; rapid movement offshore. Subscribe to our newsletter",
    "Exceptional results may not be possible; off-balance-sheet special-purpose vehicles.",
]


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


PHRASES_SQL = f"([{', '.join(map(_quoted, PHRASES))}])[CAST(doc_id % {len(PHRASES)} AS INTEGER) + 1]"
#: Where a pattern has word boundaries, letters beyond ASCII count as word characters; DuckDB's know ASCII only.
_PLAIN = r"regexp_replace(regexp_replace(lower(text), '[^\x00-\x7F\p{L}\p{Nd}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
N = f"n AS (SELECT *, {_PLAIN} AS plain FROM (SELECT doc_id, text || chr(10) || {PHRASES_SQL} AS text, source FROM documents))"
SOURCES_SQL = f"([{', '.join(map(_quoted, corpus.ALL_SOURCES))}])[CAST(CAST(substr(source, 4) AS INTEGER) % {len(corpus.ALL_SOURCES)} AS INTEGER) + 1]"
CATEGORIES_SQL = f"([{', '.join(map(_quoted, corpus.CATEGORY_WEIGHTS))}])[CAST(doc_id % {len(corpus.CATEGORY_WEIGHTS)} AS INTEGER) + 1]"
S = f"s AS (SELECT doc_id, text, lang, {SOURCES_SQL} AS source, {CATEGORIES_SQL} AS category, CASE WHEN doc_id % 3 = 0 THEN 'fraud' WHEN doc_id % 3 = 1 THEN 'non_fraud' ELSE 'unknown' END AS label FROM documents)"


def narratives(spark, sf_dir):
    """Whole documents, each with a phrase: the stand-in for narrative notes, filings and articles."""
    known = F.array(*[F.lit(p) for p in PHRASES])
    return load(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n"), F.get(known, (F.col("doc_id") % len(PHRASES)).cast("int"))).alias("text"), "source")


def samples(spark, sf_dir):
    pick = lambda known, i: F.get(F.array(*[F.lit(x) for x in known]), i.cast("int"))
    d = F.col("doc_id")
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        "lang",
        pick(corpus.ALL_SOURCES, F.substring("source", 4, 10).cast("int") % len(corpus.ALL_SOURCES)).alias("source"),
        pick(corpus.CATEGORY_WEIGHTS, d % len(corpus.CATEGORY_WEIGHTS)).alias("category"),
        F.when(d % 3 == 0, "fraud").when(d % 3 == 1, "non_fraud").otherwise("unknown").alias("label"),
    )


def _joined(c):
    return F.array_join(c, "|")


def _sql_tags(patterns: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(plain, {_quoted(p)}) THEN {_quoted(n)} END" for n, p in patterns.items())
    return f"coalesce(array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), '|'), '')"


@query("dedup_normalize", r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS key FROM documents")
def dedup_normalize(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(T.dedup_key_text(F.col("text")), 256).alias("key"))


@query("exact_dedup", r"SELECT min(doc_id) AS doc_id FROM documents GROUP BY trim(regexp_replace(lower(text), '\s+', ' ', 'g'))")
def exact_dedup(spark, sf_dir):
    return corpus.exact_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query("corpus_prefix_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY left(text, 500)")
def corpus_prefix_dedup(spark, sf_dir):
    return corpus.prefix_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


_REASON = "CASE WHEN length(text) < 100 OR length(text) // 4 < 50 THEN 'too_short' WHEN length(text) > 100000 OR length(text) // 4 > 10000 THEN 'too_long' END"


@query("dedup_length_filter", f"SELECT doc_id, {_REASON} AS reason FROM documents")
def dedup_length_filter(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", corpus.length_reason(F.col("text")).alias("reason"))


@query(
    "dedup_stats",
    rf"""WITH l AS (SELECT doc_id, source, {_REASON} AS reason, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS k FROM documents),
r AS (SELECT source, CASE WHEN reason IS NULL AND doc_id <> min(doc_id) FILTER (reason IS NULL) OVER (PARTITION BY k) THEN 'exact' ELSE coalesce(reason, 'kept') END AS reason FROM l) SELECT source, reason, count(*) AS n FROM r GROUP BY 1, 2""",
)
def dedup_stats(spark, sf_dir):
    """Length filter first (cheap), then exact duplicates among what it kept."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", corpus.length_reason(F.col("text")).alias("reason"), F.sha2(T.dedup_key_text(F.col("text")), 256).alias("k"))
    first = docs.where("reason IS NULL").groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("first"))
    out = docs.join(first, "doc_id", "left").select("source", F.coalesce("reason", F.when(F.col("first"), "kept").otherwise("exact")).alias("reason"))
    return out.groupBy("source", "reason").agg(F.count("*").alias("n"))


_SHINGLES_SQL = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) < 3 THEN [t] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS s FROM w),
b AS (SELECT doc_id, s, left(md5(array_to_string(s[1:10], '|')), 8) AS bucket FROM g),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) AS similarity FROM b x JOIN b y USING (bucket) WHERE x.doc_id < y.doc_id)"""


@query("fallback_near_dup_pairs", f"WITH {_SHINGLES_SQL} SELECT a, b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.85")
def fallback_near_dup_pairs(spark, sf_dir):
    return corpus.bucket_pairs(load(spark, sf_dir, "documents"), "doc_id", "text", 0.85).withColumn("similarity", rounded(F.col("similarity")))


@query("near_dedup")
def near_dedup(spark, sf_dir):
    """Greedy: a document goes if it is similar to an earlier one that stays."""
    return corpus.near_dedup(load(spark, sf_dir, "documents"), "doc_id", "text", 0.85).withColumnRenamed("id", "doc_id")


_HTML_SQL = "html"
for _p in T.HTML[:4]:
    _HTML_SQL = f"regexp_replace({_HTML_SQL}, '(?is){_p}', ' ', 'g')"


@query("strip_html", f"SELECT page_id, md5({_HTML_SQL}) AS h FROM pages")
def strip_html(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("h"))


def _space_sql(x: str) -> str:
    for p, by in T.WHITESPACE:
        x = f"regexp_replace({x}, '(?m){p}', {_quoted(by)}, 'g')"
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _lines_sql(x: str, patterns: list[str]) -> str:
    any_of = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    return f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT regexp_matches(l, {_quoted(any_of)})), chr(10))"


def _replaced_sql(x: str, patterns: list[str], flags: str = "(?is)", by: str = " ") -> str:
    for p in patterns:
        x = f"regexp_replace({x}, {_quoted(flags + p)}, {_quoted(by)}, 'g')"
    return x


_STRICT_SQL = _replaced_sql("html", [r"<script\b.*?</script\s*>", r"<style\b.*?</style\s*>", "<!--.*?-->", "<[^>]+>"])
for _entity, _value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
    _STRICT_SQL = f"replace({_STRICT_SQL}, {_quoted(_entity)}, {_quoted(_value)})"


@query("strip_html_strict", f"SELECT page_id, {_space_sql(_replaced_sql(_STRICT_SQL, ['&[a-zA-Z]+;', r'&#[0-9]+;']))} AS text FROM pages")
def strip_html_strict(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", T.normalize_whitespace(T.strip_html(F.col("html"), "strict")).alias("text"))


@query("normalize_whitespace", f"SELECT doc_id, md5({_space_sql('text')}) AS h FROM documents")
def normalize_whitespace(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_whitespace(F.col("text"))).alias("h"))


@query("strip_lines_matching", f"WITH {N} SELECT doc_id, md5({_lines_sql('text', T.LEGAL)}) AS h FROM n")
def strip_lines_matching(spark, sf_dir):
    return narratives(spark, sf_dir).select("doc_id", F.md5(T.strip_lines(F.col("text"), T.LEGAL)).alias("h"))


@query("clean_email", f"WITH {N} SELECT doc_id, md5({_space_sql(_lines_sql(_lines_sql('text', T.EMAIL_SIGNATURE), T.LEGAL))}) AS h FROM n")
def clean_email(spark, sf_dir):
    return narratives(spark, sf_dir).select("doc_id", F.md5(T.clean_email(F.col("text"))).alias("h"))


@query("clean_general", f"WITH {N} SELECT doc_id, md5({_space_sql(_lines_sql('text', T.LEGAL))}) AS h FROM n")
def clean_general(spark, sf_dir):
    return narratives(spark, sf_dir).select("doc_id", F.md5(T.clean_general(F.col("text"), html=False)).alias("h"))


@query("clean_general_html", f"SELECT page_id, md5({_space_sql(_lines_sql(_HTML_SQL, T.LEGAL))}) AS h FROM pages")
def clean_general_html(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.md5(T.clean_general(F.col("html"))).alias("h"))


#: Of the six patterns for HTML the last two find nothing once tags are gone.
_KEPT_HTML = _replaced_sql("t", T.HTML[:4])
_SOURCE_SQL = f"""CASE source WHEN 'sec_edgar' THEN {_space_sql(_lines_sql(_lines_sql(_replaced_sql(_KEPT_HTML, T.SEC_HEADER, '(?im)', ''), T.SEC_EXHIBIT), T.SEC_CONTENTS))}
WHEN 'gdelt' THEN {_space_sql(_replaced_sql(_lines_sql(_KEPT_HTML, T.NEWS_CALLS), [*T.NEWS_COOKIES, *T.NEWS_SOCIAL], '(?i)', ''))}
WHEN 'venmo_notes' THEN {_space_sql(_lines_sql('t', T.LEGAL))} ELSE {_space_sql(_lines_sql(_KEPT_HTML, T.LEGAL))} END"""


@query(
    "clean_by_source",
    f"WITH {S}, k AS (SELECT doc_id, source, text || chr(10) || {PHRASES_SQL} AS t FROM s), c AS (SELECT doc_id, source, CAST(length(t) AS INTEGER) AS original_length, {_SOURCE_SQL} AS x FROM k) SELECT doc_id, source, original_length, CAST(length(x) AS INTEGER) AS cleaned_length, md5(x) AS h FROM c WHERE length(x) >= 50",
)
def clean_by_source(spark, sf_dir):
    """A text is cleaned once: lengths and digest leave the chain of replacements together, as one struct, before the filter."""
    kept = F.concat("text", F.lit("\n"), F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % len(PHRASES)).cast("int")))
    cleaned = samples(spark, sf_dir).select("doc_id", "source", F.length(kept).alias("original_length"), T.clean_by_source(kept, F.col("source")).alias("text"))
    once = F.transform(F.array("text"), lambda t: F.struct(F.length(t).alias("n"), F.md5(t).alias("h")))
    # An exploded array is no projection that a filter could be pushed through.
    return cleaned.select("doc_id", "source", "original_length", F.inline(once)).where("n >= 50").select("doc_id", "source", "original_length", F.col("n").alias("cleaned_length"), "h")


@query("typology_tags", f"WITH {N} SELECT doc_id, {_sql_tags(T.TYPOLOGIES)} AS typologies FROM n")
def typology_tags(spark, sf_dir):
    return narratives(spark, sf_dir).select("doc_id", _joined(T.tags(F.col("text"), T.TYPOLOGIES)).alias("typologies"))


@query("indicators", f"WITH {N} SELECT doc_id, coalesce(array_to_string(list_filter([{', '.join(map(_quoted, T.INDICATORS))}], lambda p: contains(lower(text), p)), '|'), '') AS indicators FROM n")
def indicators(spark, sf_dir):
    return narratives(spark, sf_dir).select("doc_id", _joined(T.phrases(F.col("text"), T.INDICATORS)).alias("indicators"))


_KEYWORDS = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {_quoted(k)})' for k in ks)} THEN {_quoted(n)} END" for n, ks in T.KEYWORDS.items())


@query("keyword_typologies", f"WITH {N} SELECT doc_id, coalesce(array_to_string(list_filter([{_KEYWORDS}], lambda x: x IS NOT NULL), '|'), '') AS typologies FROM n")
def keyword_typologies(spark, sf_dir):
    return narratives(spark, sf_dir).select("doc_id", _joined(T.keyword_tags(F.col("text"), T.KEYWORDS)).alias("typologies"))


_FLAGS = ", ".join(f"regexp_extract_all(lower(text), {_quoted(p)})" for p in T.RED_FLAGS)


@query("red_flags", f"WITH {N} SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(flatten([{_FLAGS}]))), '|'), '') AS flags FROM n")
def red_flags(spark, sf_dir):
    return narratives(spark, sf_dir).select("doc_id", _joined(T.matched(F.col("text"), T.RED_FLAGS)).alias("flags"))


@query("fraud_language", f"WITH {N} SELECT doc_id, {_sql_tags({p: p for p in T.FRAUD_LANGUAGE})} AS patterns FROM n")
def fraud_language(spark, sf_dir):
    return narratives(spark, sf_dir).select("doc_id", _joined(T.found_patterns(F.col("text"), T.FRAUD_LANGUAGE)).alias("patterns"))


_RISKS = " UNION ALL ".join(f"SELECT doc_id, {_quoted(n)} AS risk, CAST(len(regexp_extract_all(plain, {_quoted(p)})) AS INTEGER) AS n FROM n" for n, p in T.RISKS.items())


@query("risk_pattern_counts", f"WITH {N}, r AS ({_RISKS}) SELECT * FROM r WHERE n > 0")
def risk_pattern_counts(spark, sf_dir):
    return narratives(spark, sf_dir).select("doc_id", F.explode(T.pattern_counts(F.col("text"), T.RISKS)).alias("risk", "n"))


@query("payment_categories", f"WITH {N} SELECT doc_id, {_sql_tags({n: '|'.join(p) for n, p in T.PAYMENTS.items()})} AS categories, {_sql_tags({n: '|'.join(p) for n, p in T.SENSITIVE.items()})} AS sensitive FROM n")
def payment_categories(spark, sf_dir):
    t = F.col("text")
    return narratives(spark, sf_dir).select("doc_id", _joined(T.any_tags(t, T.PAYMENTS)).alias("categories"), _joined(T.any_tags(t, T.SENSITIVE)).alias("sensitive"))


#: Letters beyond ASCII as a word character that no name has, so that word boundaries mean the same in both engines.
_ASCII = r"regexp_replace(text, '[^\x00-\x7F]', '_', 'g')"
_NAMES = [r"(\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+Bank\b)", r"(\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s+(?:LLC|Ltd|Inc|Corp|Limited)\b)"]
_ENTITIES_SQL = ", ".join(["regexp_extract_all(text, '\"([^\"]+)\"', 1)", *[f"regexp_extract_all({_ASCII}, {_quoted(p)}, 1)" for p in _NAMES]])


@query("extract_entities", f"WITH {N} SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(flatten([{_ENTITIES_SQL}])))[1:20], '|'), '') AS entities FROM n")
def extract_entities(spark, sf_dir):
    return narratives(spark, sf_dir).select("doc_id", _joined(T.entities(F.col("text"))).alias("entities"))


_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b"
_IP = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"


@query("pii_email_mask", f"SELECT doc_id, md5(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g')) AS h FROM documents")
def pii_email_mask(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(F.regexp_replace("text", _EMAIL, "[EMAIL]")).alias("h"))


@query("pii_ip_mask", f"SELECT doc_id, md5(regexp_replace(text, '{_IP}', '[IP_ADDRESS]', 'g')) AS h FROM documents")
def pii_ip_mask(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(F.regexp_replace("text", _IP, "[IP_ADDRESS]")).alias("h"))


@query("scrub_pii")
def scrub_pii(spark, sf_dir):
    from ledgerloom.operators import scrub

    return scrub.scrub(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", F.md5("text").alias("h"), "pii_count", F.array_join("pii_types", "|").alias("pii_types"))


@query("scrub_stats")
def scrub_stats(spark, sf_dir):
    from ledgerloom.operators import scrub

    return scrub.stats(scrub.scrub(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text"))


_CHUNK = r"""w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, text, w, CAST(CASE WHEN len(w) <= 512 THEN 1 ELSE ceil((len(w) - 512) / 448) + 1 END AS INTEGER) AS k FROM w),
x AS (SELECT *, unnest(range(k)) AS i FROM c)"""


@query(
    "char_shingles",
    """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE length(text) >= 5), l AS (SELECT doc_id, c || lead(c) OVER w || lead(c, 2) OVER w || lead(c, 3) OVER w || lead(c, 4) OVER w AS s FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
d AS (SELECT DISTINCT doc_id, s FROM l WHERE s IS NOT NULL UNION ALL SELECT doc_id, text FROM documents WHERE length(text) < 5) SELECT doc_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg(s, chr(0) ORDER BY s)) AS h FROM d GROUP BY doc_id""",
)
def char_shingles(spark, sf_dir):
    """Number and digest of the distinct runs of five characters of every text; none for a null text, as in its SQL."""
    return shingles.digests(load(spark, sf_dir, "documents"), "doc_id", "text")


@query("chunk_words", f"WITH {_CHUNK} SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, k AS total_chunks, md5(CASE WHEN len(w) <= 512 THEN text ELSE array_to_string(w[i * 448 + 1:i * 448 + 512], ' ') END) AS h FROM x")
def chunk_words(spark, sf_dir):
    out = corpus.chunk_words(load(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", "chunk_index", "total_chunks", F.md5("chunk").alias("h"))


@query(
    "corpus_stats",
    rf"""WITH {S}, z AS (SELECT source, category, lang, length(text) AS c, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM s)
SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(category) = 0 THEN 'category' WHEN grouping(lang) = 0 THEN 'lang' ELSE 'all' END AS grouping, coalesce(source, category, lang, '') AS key, count(*) AS n, CAST(sum(c) AS BIGINT) AS chars, CAST(sum(w) AS BIGINT) AS words FROM z GROUP BY GROUPING SETS ((), (source), (category), (lang))""",
)
def corpus_stats(spark, sf_dir):
    return corpus.corpus_stats(samples(spark, sf_dir))


@query("compliance_filter", f"WITH {S} SELECT source, count(*) AS n FROM s WHERE source NOT IN ({', '.join(map(_quoted, corpus.RESTRICTED))}) GROUP BY source")
def compliance_filter(spark, sf_dir):
    return samples(spark, sf_dir).where(F.col("source").isin(corpus.allowed_sources("strict"))).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "compliance_modes",
    f"WITH {S} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, source, count(*) AS n FROM s WHERE source IN ({', '.join(map(_quoted, corpus.allowed_sources(m)))}) GROUP BY source" for m in ("strict", "public_only", "all")),
)
def compliance_modes(spark, sf_dir):
    """What each mode lets through: counts by source are taken once, and modes looked up in them."""
    counts = samples(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    allowed = spark.createDataFrame([(m, x) for m in ("strict", "public_only", "all") for x in corpus.allowed_sources(m)], "mode string, source string")
    return counts.join(F.broadcast(allowed), "source").select("mode", "source", "n")


@query("source_license", f"WITH {S} SELECT doc_id, coalesce((MAP {{{', '.join(f'{_quoted(k)}: {_quoted(v)}' for k, v in corpus.LICENSES.items())}}})[source], 'unknown') AS license FROM s")
def source_license(spark, sf_dir):
    return samples(spark, sf_dir).select("doc_id", corpus.mapped(F.col("source"), corpus.LICENSES, "unknown").alias("license"))


_WEIGHT = f"coalesce((MAP {{{', '.join(f'{_quoted(k)}: {v}::DOUBLE' for k, v in corpus.SOURCE_WEIGHTS.items())}}})[source], 1.0) * coalesce((MAP {{{', '.join(f'{_quoted(k)}: {v}::DOUBLE' for k, v in corpus.CATEGORY_WEIGHTS.items())}}})[category], 1.0)"


@query(
    "weighted_resample",
    f"""WITH {S}, w AS (SELECT doc_id, {_WEIGHT} AS w, CAST(('0x' || substr(md5('mix:' || doc_id), 1, 8)) AS BIGINT) / 4294967296 AS u FROM s), c AS (SELECT doc_id, CAST(floor(w) + CASE WHEN u < w - floor(w) THEN 1 ELSE 0 END AS INTEGER) AS k FROM w)
SELECT doc_id, CAST(unnest(range(1, k + 1)) AS INTEGER) AS copy FROM c""",
)
def weighted_resample(spark, sf_dir):
    weight = corpus.mapped(F.col("source"), corpus.SOURCE_WEIGHTS, 1.0) * corpus.mapped(F.col("category"), corpus.CATEGORY_WEIGHTS, 1.0)
    return sampling.weighted_resample(samples(spark, sf_dir).select("doc_id", "source", "category"), weight, sampling.uniform("doc_id", seed="mix")).select("doc_id", "copy")


@query("limit_per_source", f"WITH {S} SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id)) AS r FROM s) WHERE r <= 10")
def limit_per_source(spark, sf_dir):
    return sampling.limit_per_key(samples(spark, sf_dir).select("doc_id", "source").withColumn("h", sampling.hash_order("doc_id")), "source", 10, "h").select("doc_id", "source")


def _balanced(key: str, keep: str = "false") -> str:
    return f"""WITH {S}, r AS (SELECT doc_id, {key}, row_number() OVER (PARTITION BY {key} ORDER BY md5('7:' || doc_id)) AS r FROM s), m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM s WHERE NOT ({keep}) GROUP BY {key}))
SELECT doc_id, {key} FROM r WHERE ({keep}) OR r <= (SELECT m FROM m)"""


def _balance(spark, sf_dir, key, keep=None):
    return sampling.balance(samples(spark, sf_dir).select("doc_id", key).withColumn("h", sampling.hash_order("doc_id")), key, "h", keep=keep).select("doc_id", key)


@query("balance_by_source", _balanced("source"))
def balance_by_source(spark, sf_dir):
    return _balance(spark, sf_dir, "source")


@query("balance_by_category", _balanced("category"))
def balance_by_category(spark, sf_dir):
    return _balance(spark, sf_dir, "category")


@query("balance_by_label", _balanced("label", "label = 'unknown'"))
def balance_by_label(spark, sf_dir):
    return _balance(spark, sf_dir, "label", ["unknown"])


@query(
    "text_samples_v2",
    f"""WITH {S} SELECT doc_id, source || '_' || left(md5(text), 12) AS sample_id, 'sha256:' || sha256(text) AS content_hash, CASE label WHEN 'fraud' THEN 'high' WHEN 'non_fraud' THEN 'low' ELSE 'unknown' END AS risk_level, length(text) AS char_count, length(text) // 4 AS token_estimate FROM s""",
)
def text_samples_v2(spark, sf_dir):
    t = F.col("text")
    risk = F.when(F.col("label") == "fraud", "high").when(F.col("label") == "non_fraud", "low").otherwise("unknown")
    return samples(spark, sf_dir).select("doc_id", T.sample_id(F.col("source"), t).alias("sample_id"), T.content_hash(t).alias("content_hash"), risk.alias("risk_level"), F.length(t).cast("long").alias("char_count"), F.floor(F.length(t) / 4).alias("token_estimate"))


@query("random_split_90_5_5", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id)) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r <= floor(n * 0.9) THEN 'train' WHEN r <= floor(n * 0.9) + floor(n * 0.05) THEN 'validation' ELSE 'test' END AS split FROM r")
def random_split(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("all")).withColumn("h", sampling.hash_order("doc_id"))
    ranked = sampling.ranked_by_hash(docs, "all", "h")
    a, b = F.floor(F.col("total") * 0.9), F.floor(F.col("total") * 0.05)
    return ranked.select("doc_id", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "validation").otherwise("test").alias("split"))


_PACK = """d AS (SELECT doc_id // 1000 AS shard, doc_id, length(text) // 4 AS n, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) AS r FROM documents WHERE length(text) // 4 > 2),
f AS (SELECT shard, doc_id, r, n, 0::BIGINT AS pack, n + 1 AS used FROM d WHERE r = 1 UNION ALL SELECT d.shard, d.doc_id, d.r, d.n, CASE WHEN used + d.n + 1 > 512 THEN pack + 1 ELSE pack END, CASE WHEN used + d.n + 1 > 512 THEN d.n + 1 ELSE used + d.n + 1 END FROM f JOIN d ON d.shard = f.shard AND d.r = f.r + 1)"""


@query("pack_documents", f"WITH RECURSIVE {_PACK} SELECT shard, doc_id, pack FROM f")
def pack_documents(spark, sf_dir):
    """A thousand ids are a shard, so shards stay small and their number grows."""
    docs = load(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 1000).alias("shard"), "doc_id", F.floor(F.length("text") / 4).alias("tokens"))
    return corpus.pack_documents(docs, "shard", "doc_id", "tokens")


@query(
    "token_cap",
    """WITH RECURSIVE d AS (SELECT doc_id, length(text) // 4 AS tokens, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE length(text) // 4 <= 50000),
f AS (SELECT doc_id, tokens, r, tokens <= 50000 AS keep, CASE WHEN tokens <= 50000 THEN tokens ELSE 0 END AS used FROM d WHERE r = 1 UNION ALL SELECT d.doc_id, d.tokens, d.r, used + d.tokens <= 50000, CASE WHEN used + d.tokens <= 50000 THEN used + d.tokens ELSE used END FROM f JOIN d ON d.r = f.r + 1) SELECT doc_id, tokens FROM f WHERE keep""",
)
def token_cap(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.floor(F.length("text") / 4).alias("tokens"))
    return corpus.token_cap(docs, "doc_id", "tokens", 50_000)


_ACTIONS = list(corpus.ACTIONS)
_A = f"a AS (SELECT user_id, list(([{', '.join(map(_quoted, _ACTIONS))}])[CAST(event_id % {len(_ACTIONS)} AS INTEGER) + 1] ORDER BY ts, event_id) AS acts FROM events GROUP BY user_id)"


def actions(spark, sf_dir):
    """All events of a user as actions in time order."""
    known = F.array(*[F.lit(a) for a in _ACTIONS])
    e = load(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", F.get(known, (F.col("event_id") % len(_ACTIONS)).cast("int")).alias("a")).alias("e"))
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["a"]).alias("actions"))


@query("action_sequence_text", f"WITH {_A} SELECT user_id, array_to_string(list_transform(acts, lambda x: x || ' (' || (MAP {{{', '.join(f'{_quoted(k)}: {_quoted(v)}' for k, v in corpus.ACTIONS.items())}}})[x] || ')'), ' → ') AS text FROM a")
def action_sequence_text(spark, sf_dir):
    return actions(spark, sf_dir).select("user_id", corpus.action_text(F.col("actions")).alias("text"))


_SUSPECT = ", ".join(f"CASE WHEN contains(j, {_quoted(' '.join(p))}) THEN {_quoted('_'.join(p[:2]))} END" for p in corpus.SUSPICIOUS)


@query(
    "suspicious_patterns",
    f"""WITH {_A}, j AS (SELECT user_id, acts, array_to_string(acts, ' ') AS j FROM a) SELECT user_id, coalesce(array_to_string(list_filter([{_SUSPECT}, CASE WHEN len(list_filter(acts, lambda x: x = 'login_failed')) >= 2 THEN 'multiple_failed_logins' END,
CASE WHEN (list_contains(acts, 'transfer_external') OR list_contains(acts, 'transfer_international')) AND len(acts) <= 4 THEN 'quick_transfer' END, CASE WHEN list_contains(acts, 'add_beneficiary') AND contains(j, 'transfer') THEN 'new_beneficiary_transfer' END,
CASE WHEN list_contains(acts, 'change_limits') THEN 'limit_modification' END], lambda x: x IS NOT NULL), '|'), '') AS patterns FROM j""",
)
def suspicious_patterns(spark, sf_dir):
    return actions(spark, sf_dir).select("user_id", _joined(corpus.suspicious_patterns(F.col("actions"))).alias("patterns"))


@query("run_incremental", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def run_incremental(spark, sf_dir):
    return corpus.incremental(load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels"), "doc_id")


@query("split_into_sections")
def split_into_sections(spark, sf_dir):
    out = sections.titled_sections(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", "section", "title", F.md5("content").alias("h"))


@query("theme_distribution", f"WITH {N}, t AS (SELECT unnest(string_split({_sql_tags(T.TYPOLOGIES)}, '|')) AS theme FROM n) SELECT theme, count(*) AS n FROM t WHERE theme <> '' GROUP BY theme")
def theme_distribution(spark, sf_dir):
    return narratives(spark, sf_dir).select(F.explode(T.tags(F.col("text"), T.TYPOLOGIES)).alias("theme")).groupBy("theme").agg(F.count("*").alias("n"))


_PERMS = 128
_MINHASH_SQL = rf"""w AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS t FROM documents),
l AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, ' '), lambda x: x <> '') AS w FROM w),
g AS (SELECT doc_id, CASE WHEN len(w) < 3 THEN [t] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM l),
x AS (SELECT DISTINCT doc_id, CAST('0x' || substr(md5(u), 1, 8) AS BIGINT) % {minhash.PRIME} AS x FROM (SELECT doc_id, unnest(s) AS u FROM g)),
c AS (SELECT j, 1 + CAST('0x' || substr(md5('a' || j), 1, 8) AS BIGINT) % {minhash.PRIME - 1} AS a, CAST('0x' || substr(md5('b' || j), 1, 8) AS BIGINT) % {minhash.PRIME} AS b FROM range({_PERMS}) AS r(j)),
m AS (SELECT doc_id, j, min((a * x + b) % {minhash.PRIME}) AS v FROM x, c GROUP BY doc_id, j)"""


@query("minhash_signatures", f"WITH {_MINHASH_SQL} SELECT doc_id, md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY j)) AS signature FROM m GROUP BY doc_id")
def minhash_signatures(spark, sf_dir):
    """Digests of the signatures of 128 permutations over word shingles."""
    docs = load(spark, sf_dir, "documents")
    signed = minhash.signatures(docs, "doc_id", T.word_shingles(T.dedup_key_text(F.coalesce("text", F.lit("")))), _PERMS)
    return signed.select(F.col("id").alias("doc_id"), F.md5(F.array_join("signature", ",")).alias("signature"))


@query(
    "minhash_near_dedup",
    f"""WITH RECURSIVE {_MINHASH_SQL},
k AS (SELECT doc_id, list(bucket) AS keys FROM (SELECT doc_id, md5(j // {minhash.bands_for(0.85, _PERMS)[1]} || ',' || string_agg(CAST(v AS VARCHAR), ',' ORDER BY j)) AS bucket FROM m WHERE j < {minhash.bands_for(0.85, _PERMS)[0] * minhash.bands_for(0.85, _PERMS)[1]} GROUP BY doc_id, j // {minhash.bands_for(0.85, _PERMS)[1]}) GROUP BY doc_id),
q AS MATERIALIZED (SELECT doc_id, keys FROM k WHERE list_has_any(keys, (SELECT list(u) FROM (SELECT unnest(keys) AS u FROM k GROUP BY u HAVING count(*) > 1)))),
o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, keys FROM q),
f(n, doc_id, stays, taken) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST([] AS VARCHAR[])
  UNION ALL SELECT o.n, o.doc_id, NOT list_has_any(f.taken, o.keys), CASE WHEN list_has_any(f.taken, o.keys) THEN f.taken ELSE list_concat(f.taken, o.keys) END FROM f JOIN o ON o.n = f.n + 1)
SELECT doc_id FROM k WHERE doc_id NOT IN (SELECT doc_id FROM q) UNION ALL SELECT doc_id FROM f WHERE stays""",
)
def minhash_near_dedup(spark, sf_dir):
    """A document goes if an earlier one that stays shares a band of its signature."""
    return minhash.near_dedup(load(spark, sf_dir, "documents"), "doc_id", "text", perms=_PERMS).withColumnRenamed("id", "doc_id")
