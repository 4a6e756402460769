"""Queries of the text loaders: raw rows in each source's layout, made of the test tables, through its loader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import entities as E
from ledgerloom.functions import text as T
from ledgerloom.operators import corpus, sections
from ledgerloom.plans.registry import ORACLES, query
from ledgerloom.plans.texts import PHRASES, S, _quoted, narratives, samples
from ledgerloom.sources import loaders
from ledgerloom.sources.tables import load, rounded

_HEAD = "left(lower(text), 500)"


@query(
    "load_sec_fraud",
    f"""WITH r AS (SELECT doc_id, trim(text) AS text, trim(source) AS company, CASE toxic WHEN 1 THEN 'Fraud case' WHEN 0 THEN 'legitimate' END AS l FROM documents LEFT JOIN labels USING (doc_id)), k AS (SELECT * FROM r WHERE length(text) >= 10)
SELECT 'sec_fraud_' || doc_id AS sample_id, md5(text) AS h, company, CASE l WHEN 'Fraud case' THEN 'fraud' WHEN 'legitimate' THEN 'non_fraud' ELSE 'unknown' END AS label, CASE WHEN contains({_HEAD}, 'risk') THEN 'risk_disclosure' WHEN contains({_HEAD}, 'financial statement') THEN 'financial_statement' ELSE 'md_and_a' END AS category FROM k""",
)
def load_sec_fraud(spark, sf_dir):
    words = F.when(F.col("toxic") == 1, "Fraud case").when(F.col("toxic") == 0, "legitimate")
    raw = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.lit("").alias("filings"), F.col("text").alias("mda"), words.alias("Label"), F.col("source").alias("Company"))
    return loaders.sec_fraud(raw, "doc_id").select("sample_id", F.md5("text").alias("h"), F.get("entities", 0).alias("company"), "label", "category")


@query("load_edgar", r"SELECT 'edgar_' || doc_id AS sample_id, md5(regexp_replace(text, '^ +| +$', '', 'g') || chr(10) || chr(10) || source) AS h, CAST(1993 + doc_id % 28 AS VARCHAR) AS year FROM documents WHERE doc_id % 28 BETWEEN 7 AND 20 AND length(regexp_replace(text, '^ +| +$', '', 'g') || source) + 2 >= 100")
def load_edgar(spark, sf_dir):
    raw = load(spark, sf_dir, "documents").select("doc_id", (1993 + F.col("doc_id") % 28).alias("year"), F.col("text").alias("section_1"), F.lit(" ").alias("section_1A"), F.col("source").alias("section_7"))
    out = loaders.edgar(raw, "doc_id", ["section_1", "section_1A", "section_7", "section_8"], list(range(2000, 2014)))
    return out.select("sample_id", F.md5("text").alias("h"), F.col("metadata")["year"].alias("year"))


_KNOWN = list(corpus.ACTIONS)
_RAW_ACTIONS = f"a AS (SELECT user_id, list(([{', '.join(map(_quoted, _KNOWN))}])[CAST(event_id % {len(_KNOWN)} AS INTEGER) + 1] ORDER BY ts, event_id)[1:50] AS acts, max(event_type) AS l, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 2)"


@query("load_fraudnlp", f"WITH {_RAW_ACTIONS} SELECT 'fraudnlp_' || user_id AS sample_id, array_to_string(list_transform(acts, lambda x: x || ' (' || (MAP {{{', '.join(f'{_quoted(k)}: {_quoted(v)}' for k, v in corpus.ACTIONS.items())}}})[x] || ')'), ' → ') AS text, CAST(len(acts) AS VARCHAR) AS action_count, 'fraud' AS label FROM a")
def load_fraudnlp(spark, sf_dir):
    """Sequences as JSON lists, words between commas, or words between arrows, by user."""
    from ledgerloom.plans.texts import actions

    a = actions(spark, sf_dir).withColumn("u", F.transform("actions", lambda x: F.upper(x)))
    told = F.when(F.col("user_id") % 3 == 0, F.to_json("u")).when(F.col("user_id") % 3 == 1, F.array_join("u", ", ")).otherwise(F.array_join("u", " → "))
    raw = a.select("user_id", told.alias("sequence"), F.lit("Yes").alias("is_fraud"))
    return loaders.fraud_actions(raw, "user_id").select("sample_id", "text", F.col("metadata")["action_count"].alias("action_count"), "label")


_KINDS = ["Person", "Organization", "Company", "LegalEntity", "PublicBody", "Vessel"]
_TOPICS = [["sanction"], ["role.pep", "gov"], ["crime.fraud"], [], ["terrorist"], ["poi", "UN list"]]
_SETS = [["us_ofac_sdn"], ["eu_fsf", "gb_hmt"], [], ["ru_list"]]


def entities(spark, sf_dir):
    """Customers as entities, with aliases, countries, positions, topics, lists and notes."""
    c = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    pick = lambda known: F.get(F.array(*[F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in known]), (k % len(known)).cast("int"))
    some = lambda when, *x: F.when(when, F.array(*x)).otherwise(F.array().cast("array<string>"))
    return c.select(
        F.col("c_custkey"),
        F.col("c_name").alias("caption"),
        F.get(F.array(*map(F.lit, _KINDS)), (k % len(_KINDS)).cast("int")).alias("schema"),
        some(k % 2 == 0, F.concat(F.lit("Alias "), "c_custkey"), F.lit("Second, name")).alias("alias"),
        some(k % 5 == 1, F.lit("Weak")).alias("weakAlias"),
        some(k % 7 != 0, "n_name").alias("country"),
        some(k % 6 == 0, F.lit("1970-01-02")).alias("birthDate"),
        some(k % 6 == 0, F.lit("ru")).alias("nationality"),
        some(k % 4 == 3, F.lit("Minister"), F.lit("Mayor")).alias("position"),
        pick(_TOPICS).alias("topics"),
        pick(_SETS).alias("datasets"),
        some(k % 3 == 0, F.repeat(F.concat(F.lit("Note "), "c_mktsegment", F.lit(" ")), 60)).alias("notes"),
        some(k % 8 == 0, F.lit("Described")).alias("description"),
    )


def _lists_sql(known: list[list[str]]) -> str:
    return f"([{', '.join('CAST([' + ', '.join(map(_quoted, x)) + '] AS VARCHAR[])' for x in known)}])[CAST(c_custkey % {len(known)} AS INTEGER) + 1]"


_ENTITIES = f"""e AS (SELECT c_custkey AS k, c_name AS name, ([{', '.join(map(_quoted, _KINDS))}])[CAST(c_custkey % {len(_KINDS)} AS INTEGER) + 1] AS sch, CASE WHEN c_custkey % 2 = 0 THEN ['Alias ' || c_custkey, 'Second, name'] ELSE [] END AS a0, CASE WHEN c_custkey % 5 = 1 THEN ['Weak'] ELSE [] END AS weak,
CASE WHEN c_custkey % 7 <> 0 THEN [n_name] ELSE [] END AS country, CASE WHEN c_custkey % 6 = 0 THEN ['1970-01-02'] ELSE [] END AS birth, CASE WHEN c_custkey % 6 = 0 THEN ['ru'] ELSE [] END AS nat, CASE WHEN c_custkey % 4 = 3 THEN ['Minister', 'Mayor'] ELSE [] END AS pos,
{_lists_sql(_TOPICS)} AS topics, {_lists_sql(_SETS)} AS sets, CASE WHEN c_custkey % 3 = 0 THEN [repeat('Note ' || c_mktsegment || ' ', 60)] ELSE [] END AS notes, CASE WHEN c_custkey % 8 = 0 THEN ['Described'] ELSE [] END AS described FROM customer JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT *, CASE WHEN len(a0) > 0 THEN a0 ELSE weak END AS alias, lower(array_to_string(list_concat(topics, sets), ' ')) AS found, lower(array_to_string(topics, ' ')) || ' ' || lower(array_to_string(sets, ' ')) AS found2 FROM e),
g AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {' OR '.join(f'contains(found, {_quoted(x.lower())})' for x in ks)} THEN {_quoted(n)} END" for n, ks in E.RISK_CLASSES.items())}], lambda x: x IS NOT NULL) AS risks,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {' OR '.join(f'contains(found2, {_quoted(x)})' for x in ks)} THEN {_quoted(n)} END" for n, ks in E.STATUS_WORDS.items())}], lambda x: x IS NOT NULL), ', ') AS status,
  CASE sch {' '.join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in E.KIND_WORDS.items())} ELSE 'entity' END AS kind FROM f)"""


@query("entity_risk", f"WITH {_ENTITIES} SELECT k, array_to_string(risks, ',') AS risks, CASE WHEN list_contains(risks, 'pep') THEN 'pep_profile' WHEN list_contains(risks, 'sanctions') THEN 'sanctions_reason' ELSE 'entity_description' END AS category, CASE WHEN len(risks) > 0 THEN 'suspicious' ELSE 'unknown' END AS label FROM g")
def entity_risk(spark, sf_dir):
    out = loaders.watch_list(entities(spark, sf_dir), "c_custkey")
    return out.select(F.regexp_extract("sample_id", "[0-9]+$", 0).cast("bigint").alias("k"), F.col("metadata")["risk_categories"].alias("risks"), "category", "label")


def _entity_text(spark, sf_dir, mode):
    out = loaders.watch_list(entities(spark, sf_dir), "c_custkey", mode)
    return out.select(F.regexp_extract("sample_id", "[0-9]+$", 0).cast("bigint").alias("k"), "text")


def _part(when: str, text: str) -> str:
    return f"CASE WHEN {when} THEN {text} END"


@query(
    "entity_text_simple",
    f"""WITH {_ENTITIES} SELECT k, concat_ws(' | ', 'Entity: ' || name, 'Type: ' || sch, {_part('len(alias) > 0', "'Also known as: ' || array_to_string(alias[1:5], ', ')")}, {_part('len(country) > 0', "'Country: ' || array_to_string(country, ', ')")}, {_part('len(birth) > 0', "'Birth date: ' || birth[1]")}, {_part('len(pos) > 0', "'Position: ' || array_to_string(pos[1:3], ', ')")},
{_part('len(topics) > 0', "'Program/Topic: ' || array_to_string(topics, ', ')")}, {_part('len(notes) > 0', "'Notes: ' || left(notes[1], 500)")}, {_part('len(described) > 0', "'Description: ' || left(described[1], 500)")}) AS text FROM g""",
)
def entity_text_simple(spark, sf_dir):
    return _entity_text(spark, sf_dir, "simple")


@query(
    "entity_text_enriched",
    f"""WITH {_ENTITIES} SELECT k, concat_ws(' ', trim(name || ' is a ' || CASE WHEN status = '' THEN 'of interest' ELSE status END || ' ' || kind || ' ' || CASE WHEN len(country) > 0 THEN 'from ' || array_to_string(country, ', ') ELSE '' END) || '.', {_part('len(alias) > 0', "'Also known as: ' || array_to_string(alias[1:5], ', ') || '.'")},
{_part('len(pos) > 0', "'Held position(s): ' || array_to_string(pos[1:3], ', ') || '.'")}, {_part('len(sets) > 0', "'Listed under: ' || array_to_string(sets[1:3], ', ') || '.'")}, {_part('len(notes) > 0', 'left(notes[1], 300)')}) AS text FROM g""",
)
def entity_text_enriched(spark, sf_dir):
    return _entity_text(spark, sf_dir, "enriched")


@query(
    "entity_text_narrative",
    f"""WITH {_ENTITIES}, h AS (SELECT *, CASE sch WHEN 'PublicBody' THEN 'government body' ELSE kind END AS kd, CASE WHEN len(notes) > 0 THEN notes ELSE described END AS n2 FROM g)
SELECT k, concat_ws(chr(10) || chr(10), concat_ws('. ', name || ' is a ' || kd, {_part('len(country) > 0', "'associated with ' || array_to_string(country, ', ')")}, {_part('len(birth) > 0', "'born ' || birth[1]")}, {_part('len(nat) > 0', "'with ' || array_to_string(nat, ', ') || ' nationality'")}) || '.',
{_part('len(sets) + len(topics) > 0', f'''concat_ws('. ', {_part('len(sets) > 0', "'This ' || kd || ' appears in the following databases: ' || array_to_string(sets[1:5], ', ')")}, {_part('len(topics) > 0', "'Relevant topics include: ' || array_to_string(topics[1:5], ', ')")}) || '.' ''')},
{_part('len(n2) > 0', 'left(n2[1], 500)')}, {_part('len(alias) > 0', "'This ' || kd || ' may also be known by the following names: ' || array_to_string(alias[1:10], ', ') || '.'")}) AS text FROM h""",
)
def entity_text_narrative(spark, sf_dir):
    return _entity_text(spark, sf_dir, "narrative")


_NOTES = ["Pizza  and drinks 🍕", "x", "poker night", "rent for May 🏠", "", "Haircut + gym"]


@query(
    "load_venmo",
    f"""WITH r AS (SELECT c_custkey, ([{', '.join(map(_quoted, _NOTES))}])[CAST(c_custkey % {len(_NOTES)} AS INTEGER) + 1] AS note, c_acctbal FROM customer), n AS (SELECT c_custkey, trim(regexp_replace(CASE WHEN note = '' THEN 'Fallback coffee' ELSE note END, '\\s+', ' ', 'g')) AS text, c_acctbal FROM r)
SELECT 'venmo_' || c_custkey AS sample_id, text, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(lower(text), {_quoted('|'.join(p))}) THEN {_quoted(n)} END" for n, p in T.PAYMENTS.items())}], lambda x: x IS NOT NULL), ',') AS typologies,
  CAST(regexp_matches(text, '[\\x{{1F300}}-\\x{{1F9FF}}]') AS VARCHAR) AS has_emoji, round(abs(c_acctbal), 2) AS amount FROM n WHERE length(text) BETWEEN 2 AND 500 AND NOT ({' OR '.join(f"regexp_matches(lower(text), {_quoted('|'.join(p))})" for p in T.SENSITIVE.values())})""",
)
def load_venmo(spark, sf_dir):
    note = F.get(F.array(*map(F.lit, _NOTES)), (F.col("c_custkey") % len(_NOTES)).cast("int"))
    raw = load(spark, sf_dir, "customer").select("c_custkey", note.alias("note"), F.lit("Fallback coffee").alias("description"), F.concat(F.lit("$"), F.abs("c_acctbal").cast("decimal(18,2)").cast("string")).alias("amount"))
    out = loaders.payment_notes(raw, "c_custkey")
    return out.select("sample_id", "text", F.array_join("typologies", ",").alias("typologies"), F.col("metadata")["has_emoji"].alias("has_emoji"), rounded(F.col("metadata")["amount"], 2).alias("amount"))


@query("load_fincen", "SELECT 'fincen_' || o_orderkey AS sample_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Wire by customer ' || o_custkey || ' without any apparent business purpose seen' ELSE 'Customer: ' || o_custkey || ' | Amount: ' || 'USD ' || o_custkey || '.5' || ' | Priority: ' || o_orderpriority || ' and so on, as filed' END AS text, o_custkey + 0.5 AS amount FROM orders")
def load_fincen(spark, sf_dir):
    """Reports with a narrative, and reports of fields alone."""
    o = load(spark, sf_dir, "orders")
    told = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Wire by customer "), "o_custkey", F.lit(" without any apparent business purpose seen"))).otherwise("  ")
    raw = o.select("o_orderkey", F.col("o_custkey").alias("Customer"), F.concat(F.lit("USD "), "o_custkey", F.lit(".5")).alias("Amount"), F.concat("o_orderpriority", F.lit(" and so on, as filed")).alias("Priority"), told.alias("Narrative"))
    out = loaders.narratives(raw, "o_orderkey", least=20)
    return out.select("sample_id", "text", F.col("metadata")["amount"].cast("double").alias("amount"))


_THEMES = ["TAX_EVASION;ECON", "ORGANIZED_CRIME_FRAUD", "", "WB_SANCTIONS; TAX", "ECON_STOCK"]


@query(
    "load_gdelt",
    f"""WITH r AS (SELECT c_custkey AS k, c_name, n_name, ([{', '.join(map(_quoted, _THEMES))}])[CAST(c_custkey % {len(_THEMES)} AS INTEGER) + 1] AS t FROM customer JOIN nation ON c_nationkey = n_nationkey), l AS (SELECT *, list_filter(list_transform(string_split(t, ';'), lambda x: trim(x)), lambda x: x <> '') AS themes FROM r),
f AS (SELECT *, flatten(list_transform(themes, lambda t: list_filter([{', '.join(f"CASE WHEN contains(lower(t), {_quoted(a.lower())}) THEN {_quoted(b)} END" for a, b in loaders.THEMES.items())}], lambda x: x IS NOT NULL))) AS found FROM l)
SELECT 'gdelt_' || k AS sample_id, concat_ws(' | ', 'Title: About ' || c_name, 'Country: ' || n_name, 'Organizations: ' || c_name || ', Other Corp', CASE WHEN len(themes) > 0 THEN 'Themes: ' || array_to_string(themes[1:5], ', ') END) AS text, coalesce(array_to_string(found, ','), '') AS indicators, CASE WHEN len(found) > 0 THEN 'adverse_media' ELSE 'news_article' END AS category FROM f""",
)
def load_gdelt(spark, sf_dir):
    c = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = c.select("c_custkey", F.concat(F.lit("About "), "c_name").alias("title"), F.col("n_name").alias("country"), F.concat("c_name", F.lit("; Other Corp")).alias("organizations"), F.get(F.array(*map(F.lit, _THEMES)), (F.col("c_custkey") % len(_THEMES)).cast("int")).alias("themes"))
    return loaders.articles(raw, "c_custkey").select("sample_id", "text", F.array_join("indicators", ",").alias("indicators"), "category")


@query("filter_text_length", f"WITH {S} SELECT doc_id FROM s WHERE length(text) BETWEEN 200 AND 5000")
def filter_text_length(spark, sf_dir):
    return samples(spark, sf_dir).where(loaders.text_length(200, 5000)).select("doc_id")


@query("filter_categories", f"WITH {S} SELECT doc_id, category, label FROM s WHERE category NOT IN ('payment_memo') AND label IN ('fraud', 'unknown')")
def filter_categories(spark, sf_dir):
    return samples(spark, sf_dir).where(loaders.in_categories(excluded=["payment_memo"], labels=["fraud", "unknown"])).select("doc_id", "category", "label")


@query("min_length_after_clean", "SELECT page_id FROM pages WHERE length(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', '', 'g')) >= 50")
def min_length_after_clean(spark, sf_dir):
    """Pages of which 50 characters or more that are no white space are left without tags."""
    left = F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"\s+", "")
    return load(spark, sf_dir, "pages").where(F.length(left) >= 50).select("page_id")


@query("label_filter", "SELECT doc_id, toxic FROM documents JOIN labels USING (doc_id)")
def label_filter(spark, sf_dir):
    """Rows without a label are dropped."""
    rows = load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.withColumn("is_labeled", F.col("toxic").isNotNull().cast("int")).where("is_labeled = 1").select("doc_id", "toxic")


@query("fraud_edge_predicate", "SELECT event_id FROM events WHERE value >= 95 OR event_type = 'purchase'")
def fraud_edge_predicate(spark, sf_dir):
    """Any of three names of the flag, of which the table has two."""
    e = load(spark, sf_dir, "events").select("event_id", (F.col("value") >= 95).cast("int").alias("isFraud"), (F.col("event_type") == "purchase").alias("is_money_laundering"))
    return e.where(loaders.any_alias(e, ["is_fraud", "isFraud", "is_money_laundering"])).select("event_id")


@query(
    "loader_predicates",
    f"WITH {_ENTITIES} SELECT 'opensanctions_' || k AS sample_id, 'country' AS predicate FROM g WHERE len(list_filter(country, lambda c: contains(lower(c), 'nation_1'))) > 0 UNION ALL SELECT 'opensanctions_' || k, 'pep' FROM g WHERE list_contains(risks, 'pep') UNION ALL SELECT 'fincen_' || o_orderkey, 'amount' FROM orders WHERE o_custkey + 0.5 >= 100",
)
def loader_predicates(spark, sf_dir):
    listed = loaders.watch_list(entities(spark, sf_dir), "c_custkey")
    filed = loaders.narratives(load(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("USD "), "o_custkey", F.lit(".5")).alias("amount"), F.lit("A long enough narrative of what was filed in this case").alias("narrative")), "o_orderkey")
    found = [(listed, loaders.in_country("Nation_1"), "country"), (listed, F.col("category") == "pep_profile", "pep"), (filed, loaders.amount_at_least(100), "amount")]
    parts = [df.where(c).select("sample_id", F.lit(n).alias("predicate")) for df, c, n in found]
    return parts[0].union(parts[1]).union(parts[2])


@query("training_format", f"WITH {S} SELECT doc_id, md5(text) AS text, label, category, source FROM s")
def training_format(spark, sf_dir):
    out = loaders.training_format(samples(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", F.md5("text").alias("text"), "label", "category", "source")


@query("jsonl_v2", f"WITH {_ENTITIES} SELECT 'opensanctions_' || k AS sample_id, CASE WHEN len(risks) > 0 THEN 'medium' ELSE 'unknown' END AS risk_level, array_to_string(risks, ',') AS typologies, array_to_string(list_concat([name], a0), ';') AS entities FROM g")
def jsonl_v2(spark, sf_dir):
    """Nested samples written as JSON lines and read back."""
    from ledgerloom.plans.sources_sinks import _folder

    at = _folder(spark, "v2")
    nested = loaders.v2_format(loaders.watch_list(entities(spark, sf_dir), "c_custkey"))
    nested.write.json(at)
    back = spark.read.schema(nested.schema).json(at)
    return back.select("sample_id", F.col("labels.risk_level").alias("risk_level"), F.array_join("labels.typologies", ",").alias("typologies"), F.array_join("entities", ";").alias("entities"))


@query("is_case_study", f"WITH n AS (SELECT doc_id, lower(text) || CASE doc_id % 3 WHEN 0 THEN ' in this example' WHEN 1 THEN ' case no. 12' ELSE '' END AS t FROM documents) SELECT doc_id, regexp_matches(t, {_quoted('|'.join(f'(?:{p})' for p in E.CASE_STUDY))}) AS is_case_study FROM n")
def is_case_study(spark, sf_dir):
    told = F.when(F.col("doc_id") % 3 == 0, " IN THIS example").when(F.col("doc_id") % 3 == 1, " Case No. 12").otherwise("")
    return load(spark, sf_dir, "documents").select("doc_id", E.is_case_study(F.concat("text", told)).alias("is_case_study"))


@query("has_emoji", "SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 5 = 0 THEN '😀' ELSE '☃' END, '[\\x{1F300}-\\x{1F9FF}]') AS has_emoji FROM documents")
def has_emoji(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", E.has_emoji(F.concat("text", F.when(F.col("doc_id") % 5 == 0, "😀").otherwise("☃"))).alias("has_emoji"))


@query("normalize_text_full")
def normalize_text_full(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_full(F.col("text"))).alias("h"))


_DISTRIBUTIONS = {"typology": T.TYPOLOGIES, "payment": {n: "|".join(p) for n, p in T.PAYMENTS.items()}}


@query(
    "distributions",
    f"""WITH {_ENTITIES} SELECT 'country' AS kind, c AS value, count(*) AS n FROM (SELECT unnest(country) AS c FROM g) GROUP BY c UNION ALL SELECT 'dataset', d, count(*) FROM (SELECT unnest(sets) AS d FROM g) GROUP BY d UNION ALL SELECT 'action', a, count(*) FROM (SELECT ([{', '.join(map(_quoted, _KNOWN))}])[CAST(event_id % {len(_KNOWN)} AS INTEGER) + 1] AS a FROM events) GROUP BY a
UNION ALL SELECT 'word_count', CAST(w AS VARCHAR), count(*) FROM (SELECT len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) // 100 AS w FROM documents) GROUP BY w""",
)
def distributions(spark, sf_dir):
    """Counts by country, dataset, action and hundred words."""
    e = entities(spark, sf_dir)
    known = F.array(*map(F.lit, _KNOWN))
    parts = [
        ("country", e.select(F.explode("country").alias("value"))),
        ("dataset", e.select(F.explode("datasets").alias("value"))),
        ("action", load(spark, sf_dir, "events").select(F.get(known, (F.col("event_id") % len(_KNOWN)).cast("int")).alias("value"))),
        ("word_count", load(spark, sf_dir, "documents").select(F.floor(F.size(T.words(F.col("text"))) / 100).cast("string").alias("value"))),
    ]
    out = [df.groupBy("value").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n") for kind, df in parts]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("narrative_sections")
def narrative_sections(spark, sf_dir):
    """Sections by the seven kinds of headers, each with its typologies and whether it is a case study."""
    out = sections.titled_sections(narratives(spark, sf_dir), "doc_id", "text")
    return out.select("doc_id", "section", "title", F.array_join(T.keyword_tags(F.col("content"), T.KEYWORDS), "|").alias("typologies"), E.is_case_study(F.col("content")).alias("is_case_study"))


_TOLD_SQL = f"told AS (SELECT doc_id, text || chr(10) || ([{', '.join(map(_quoted, PHRASES))}])[CAST(doc_id % {len(PHRASES)} AS INTEGER) + 1] AS text, 'Reason ' || source AS reason FROM documents)"
_TYPOLOGY = "shell_company"


@query(
    "sample_filters",
    f"""WITH {_RAW_ACTIONS}, {_TOLD_SQL} SELECT 'fincen_' || doc_id AS sample_id, 'typology' AS predicate FROM told WHERE regexp_matches(lower(text), {_quoted(T.TYPOLOGIES[_TYPOLOGY])})
UNION ALL SELECT 'fincen_' || doc_id, 'reason' FROM told WHERE contains(lower(reason), 'src1') UNION ALL SELECT 'fraudnlp_' || user_id, 'actions' FROM a WHERE len(acts) BETWEEN 5 AND 12""",
)
def sample_filters(spark, sf_dir):
    """Samples by typology, by a part of the filing reason (in any case) and by the number of actions."""
    from ledgerloom.plans.texts import actions

    told = narratives(spark, sf_dir).select("doc_id", F.col("text").alias("Narrative"), F.concat(F.lit("Reason "), "source").alias("Filing_Reason"))
    filed = loaders.narratives(told, "doc_id", least=1)
    acted = loaders.fraud_actions(actions(spark, sf_dir).select("user_id", F.to_json(F.transform("actions", lambda x: F.upper(x))).alias("sequence")), "user_id")
    found = [(filed, loaders.has_typology(_TYPOLOGY), "typology"), (filed, loaders.reason_contains("SRC1"), "reason"), (acted, loaders.actions_between(5, 12), "actions")]
    parts = [df.where(c).select("sample_id", F.lit(n).alias("predicate")) for df, c, n in found]
    return parts[0].union(parts[1]).union(parts[2])


_NOTE_SQL = f"(SELECT trim(regexp_replace(CASE WHEN note = '' THEN 'Fallback coffee' ELSE note END, '\\s+', ' ', 'g')) AS text FROM (SELECT ([{', '.join(map(_quoted, _NOTES))}])[CAST(c_custkey % {len(_NOTES)} AS INTEGER) + 1] AS note FROM customer))"


@query(
    "payment_and_theme_distributions",
    f"""WITH {_TOLD_SQL}, p AS (SELECT text FROM {_NOTE_SQL} WHERE length(text) BETWEEN 2 AND 500 AND NOT ({' OR '.join(f"regexp_matches(lower(text), {_quoted('|'.join(p))})" for p in T.SENSITIVE.values())})),
c AS ({' UNION ALL '.join(f"SELECT {_quoted(n)} AS value FROM p WHERE regexp_matches(lower(text), {_quoted('|'.join(x))})" for n, x in T.PAYMENTS.items())}),
t AS ({' UNION ALL '.join(f"SELECT {_quoted(n)} AS value FROM told WHERE regexp_matches(lower(text), {_quoted(x)})" for n, x in T.TYPOLOGIES.items())}),
r AS (SELECT value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, value) AS place FROM t GROUP BY value)
SELECT 'payment' AS kind, value, count(*) AS n FROM c GROUP BY value UNION ALL SELECT 'theme', value, n FROM r WHERE place <= 50""",
)
def payment_and_theme_distributions(spark, sf_dir):
    """Counts by payment category, and of the fifty most frequent themes (ties by name)."""
    note = F.get(F.array(*map(F.lit, _NOTES)), (F.col("c_custkey") % len(_NOTES)).cast("int"))
    paid = loaders.payment_notes(load(spark, sf_dir, "customer").select("c_custkey", note.alias("note"), F.lit("Fallback coffee").alias("description"), F.lit(None).cast("string").alias("amount")), "c_custkey")
    themes = narratives(spark, sf_dir).select(F.explode(T.tags(F.col("text"), T.TYPOLOGIES)).alias("value"))
    counted = lambda df: df.groupBy("value").agg(F.count("*").alias("n"))
    top = counted(themes).orderBy(F.desc("n"), "value").limit(50)
    return counted(paid.select(F.explode("typologies").alias("value"))).select(F.lit("payment").alias("kind"), "value", "n").union(top.select(F.lit("theme"), "value", "n"))


@query("load_venmo_bson", ORACLES["load_venmo"])
def load_venmo_bson(spark, sf_dir):
    """Payment notes from BSON files, plain and packed by xz, read by splits."""
    from ledgerloom.plans.sources_sinks import _folder
    from ledgerloom.sources import bson

    note = F.get(F.array(*map(F.lit, _NOTES)), (F.col("c_custkey") % len(_NOTES)).cast("int"))
    rows = load(spark, sf_dir, "customer").select(F.struct(F.col("c_custkey").alias("id"), F.struct(note.alias("note"), F.lit("Fallback coffee").alias("description"), F.abs("c_acctbal").cast("double").alias("amount")).alias("payment")).alias("doc")).select("doc.*")
    at = _folder(spark, "bson")
    bson.write_bson(rows.where("id % 3 > 0"), at)
    bson.write_bson(rows.where("id % 3 = 0"), at, packed=True)
    form = "id bigint, payment struct<note:string,description:string,amount:double>"
    read = bson.read_bson(spark, at, split_bytes=1 << 16).select(F.from_json("document", form).alias("d"))
    raw = read.select(F.col("d.id").alias("c_custkey"), "d.payment.note", "d.payment.description", F.col("d.payment.amount").cast("decimal(18,2)").cast("string").alias("amount"))
    out = loaders.payment_notes(raw, "c_custkey")
    return out.select("sample_id", "text", F.array_join("typologies", ",").alias("typologies"), F.col("metadata")["has_emoji"].alias("has_emoji"), rounded(F.col("metadata")["amount"], 2).alias("amount"))


@query("load_fatf_pdf", "SELECT doc_id, md5(text) AS h FROM documents WHERE text IS NOT NULL")
def load_fatf_pdf(spark, sf_dir):
    """Reports as pages of PDF files, read back: a page begins with its number in the register."""
    from ledgerloom.plans.sources_sinks import _folder
    from ledgerloom.sources import pdf

    at = _folder(spark, "pdf")
    docs = load(spark, sf_dir, "documents").where("text IS NOT NULL")
    pdf.write_pdf(docs.select(F.concat_ws("\n", "doc_id", "text").alias("page")), "page", at)
    pages = pdf.read_pdf(spark, at)
    return pages.select(F.expr("substring(text, 1, instr(text, '\n') - 1)").cast("bigint").alias("doc_id"), F.md5(F.expr("substring(text, instr(text, '\n') + 1)")).alias("h"))
