"""Loaders of text sources: from rows as they come to the common sample columns.

Each loader is a plan over a DataFrame of raw rows (any reader's output); columns that the raw rows lack count as
null, so one loader serves all the layouts of a source. The common columns are text, source, sample_id, category,
label, entities, typologies, indicators and metadata (a map of strings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import entities as E
from ledgerloom.functions import text as T
from ledgerloom.operators import corpus
from ledgerloom.sources import readers

# Columns that may hold a field, the first that has it counts.
NARRATIVE_COLUMNS = ["narrative", "description", "sar_narrative", "suspicious_activity_description", "notes", "comment", "reason", "filing_reason"]
THEMES = {
    "TAX_EVASION": "Tax evasion",
    "CORRUPTION": "Corruption",
    "ORGANIZED_CRIME": "Organized crime",
    "MONEY_LAUNDERING": "Money laundering",
    "FRAUD": "Fraud",
    "SANCTIONS": "Sanctions",
    "TERROR_FINANCING": "Terror financing",
    "FINANCIAL_CRIME": "Financial crime",
}
SEC_TEXT = ["Fillings", "filings", "MD&A", "mda", "text", "content"]
SEC_LABEL = ["Label", "label", "fraud", "is_fraud", "fraudulent"]
SEC_COMPANY = ["Company", "company", "name", "company_name", "ticker"]
ACTION_COLUMNS = ["actions", "sequence", "action_sequence", "events", "steps"]
ACTION_LABEL = ["fraud", "is_fraud", "label", "fraudulent", "suspicious"]
#: Actions a sequence at most, lengths of notes.
MOST_ACTIONS, NOTE_LENGTH = 50, (2, 500)


def _present(df: DataFrame, names: list[str]) -> list[str]:
    """Of the names, those that are columns (exactly)."""
    return [n for n in names if n in df.columns]


def _field(name: str) -> Column:
    return F.col(f"`{name}`")


def filled(df: DataFrame, names: list[str]) -> Column:
    """The first of the columns that is not blank, trimmed; null if none is."""
    some = [F.nullif(F.trim(_field(n).cast("string")), F.lit("")) for n in _present(df, names)]
    return F.coalesce(*some, F.lit(None).cast("string")) if some else F.lit(None).cast("string")


def _none(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def sample(text: Column, source: str, sample_id: Column, category: Column, label: Column, metadata: dict[str, Column], entities: Column | None = None, typologies: Column | None = None, indicators: Column | None = None) -> list[Column]:
    parts = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return [
        text.alias("text"),
        F.lit(source).alias("source"),
        sample_id.alias("sample_id"),
        category.alias("category"),
        label.alias("label"),
        (_none() if entities is None else entities).alias("entities"),
        (_none() if typologies is None else typologies).alias("typologies"),
        (_none() if indicators is None else indicators).alias("indicators"),
        (F.create_map(*parts) if parts else F.create_map().cast("map<string,string>")).alias("metadata"),
    ]


def typed_label(df: DataFrame, names: list[str], words: Column | None = None) -> Column:
    """fraud, non_fraud or unknown from the first of the columns that exists: true or 1, other numbers, words as ``words`` reads them."""
    have = _present(df, names)
    if not have:
        return F.lit("unknown")
    kind, c = dict(df.dtypes)[have[0]], _field(have[0])
    if kind == "string":
        return F.coalesce(words(c) if callable(words) else F.lit(None).cast("string"), F.lit("unknown"))
    return F.when(c.isNull(), "unknown").when(c.cast("double") == 1, "fraud").otherwise("non_fraud")


def sec_words(c: Column) -> Column:
    """A string that names fraud is fraud, also "non-fraud": the order of these rules is the source's own."""
    low = F.lower(c)
    return F.when(F.contains(low, F.lit("fraud")) | (c == "1"), "fraud").when(F.contains(low, F.lit("non")) | F.contains(low, F.lit("legitimate")) | (c == "0"), "non_fraud")


def action_words(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin("1", "true", "fraud", "yes"), "fraud").when(low.isin("0", "false", "legitimate", "no"), "non_fraud")


def sec_fraud(df: DataFrame, id: str, least: int = 10) -> DataFrame:
    """Filings with a fraud label; texts shorter than ``least`` are dropped. The category is told by the first 500 characters, as the source defines it."""
    head = F.substring(F.lower("text"), 1, 500)
    rows = df.withColumns({"__text": filled(df, SEC_TEXT), "__label": typed_label(df, SEC_LABEL, sec_words), "__company": filled(df, SEC_COMPANY)})
    rows = rows.where(F.length("__text") >= least).select(F.col(id).alias("__id"), F.col("__text").alias("text"), "__label", "__company")
    category = F.when(F.contains(head, F.lit("risk")), "risk_disclosure").when(F.contains(head, F.lit("financial statement")), "financial_statement").otherwise("md_and_a")
    found = T.found_patterns(F.col("text"), T.FRAUD_LANGUAGE)
    risks = F.to_json(T.pattern_counts(F.col("text"), T.RISKS))
    about = {"company": F.col("__company"), "risk_patterns": risks, "fraud_indicator_count": F.size(found)}
    return rows.select(*sample(F.col("text"), "sec_edgar", F.concat(F.lit("sec_fraud_"), F.col("__id")), category, F.col("__label"), about, entities=F.array_compact(F.array("__company")), indicators=found))


def edgar(df: DataFrame, id: str, sections: list[str], years: list[int] | None = None, least: int = 100) -> DataFrame:
    """Chosen sections of a filing, joined by blank lines; filtered by year before any text is joined."""
    if years is not None:
        df = df.where(F.col("year").isin(years))
    text = F.concat_ws("\n\n", *[F.nullif(F.trim(_field(s)), F.lit("")) for s in _present(df, sections)])
    rows = df.select(F.col(id).alias("__id"), F.col("year"), text.alias("text")).where(F.length("text") >= least)
    return rows.select(*sample(F.col("text"), "sec_edgar", F.concat(F.lit("edgar_"), F.col("__id")), F.lit("md_and_a"), F.lit("unknown"), {"year": F.col("year")}))


def parsed_actions(df: DataFrame) -> Column:
    """array<string> from the first of the columns that exists: a list, a JSON list, or words between commas, spaces or arrows."""
    have = _present(df, ACTION_COLUMNS)
    if not have:
        return _none()
    c = _field(have[0])
    if not dict(df.dtypes)[have[0]].startswith("array"):
        bare = F.split(F.regexp_replace(c, r"^[\[\]]+|[\[\]]+$", ""), ",")
        c = F.when(c.startswith("["), F.coalesce(F.from_json(c, "array<string>"), bare)).otherwise(F.split(c, r"[,\s→]+"))
    c = F.when(F.size(c) >= 2, c).otherwise(_none())
    return F.slice(F.filter(F.transform(c, lambda a: F.lower(F.trim(a))), lambda a: a != ""), 1, MOST_ACTIONS)


def fraud_actions(df: DataFrame, id: str, least: int = 10) -> DataFrame:
    """Action sequences as texts, with the patterns that are suspicious."""
    user = filled(df, ["user_id", "user", "customer_id"])
    rows = df.select(F.col(id).alias("__id"), parsed_actions(df).alias("__actions"), typed_label(df, ACTION_LABEL, action_words).alias("__label"), user.alias("__user"))
    rows = rows.where(F.size("__actions") > 0).withColumn("text", corpus.action_text(F.col("__actions"))).where(F.length("text") >= least)
    found = corpus.suspicious_patterns(F.col("__actions"))
    about = {"actions": F.array_join("__actions", " "), "action_count": F.size("__actions"), "user_id": F.col("__user")}
    return rows.select(*sample(F.col("text"), "fraudnlp", F.concat(F.lit("fraudnlp_"), F.col("__id")), F.lit("action_sequence"), F.col("__label"), about, typologies=found, indicators=found))


def watch_list(df: DataFrame, id: str, mode: str = "simple") -> DataFrame:
    """Entities with their lists as columns (absent ones are empty); text by template, class by topics, programmes and datasets."""
    lists = {c: F.coalesce(F.col(c), _none()) if c in df.columns else _none() for c in E.LISTS}
    names = {c: F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("caption", "name", "schema")}
    rows = df.withColumns(lists | names).withColumn("__risks", E.risk_classes())
    text = {"simple": E.simple_text, "enriched": E.enriched_text, "narrative": E.narrative_text}[mode]()
    risks = F.col("__risks")
    about = {"risk_categories": F.array_join(risks, ","), "countries": F.array_join("country", ",")}
    entities = F.array_compact(F.concat(F.array(F.coalesce("caption", "name")), F.slice("alias", 1, 5)))
    return rows.select(*sample(text, "opensanctions", F.concat(F.lit("opensanctions_"), F.col(id)), E.category(risks), E.label(risks), about, entities=entities, typologies=risks)).where("text <> ''")


def articles(df: DataFrame, id: str, least: int = 10) -> DataFrame:
    """News articles; themes, organisations and persons are lists, or joined by semicolons. Themes that name a crime are indicators, one for each theme and crime."""
    lists = ["themes", "organizations", "persons"]
    kinds = dict(df.dtypes)
    rows = df.withColumns({c: _none() if c not in kinds else F.coalesce(F.col(c), _none()) if kinds[c].startswith("array") else F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "") for c in lists})
    told = [F.concat(F.lit(f"{n.title()}: "), filled(df, [n])) for n in ("title", "source", "country")]
    told += [F.when(F.size(c) > 0, F.concat(F.lit(f"{c.title()}: "), F.array_join(F.slice(c, 1, 5), ", "))) for c in ("organizations", "persons", "themes")]
    crimes = F.array(*[F.struct(F.lit(k.lower()).alias("key"), F.lit(v).alias("name")) for k, v in THEMES.items()])
    found = F.flatten(F.transform("themes", lambda t: F.transform(F.filter(crimes, lambda c: F.contains(F.lower(t), c["key"])), lambda c: c["name"])))
    rows = rows.withColumn("__found", found).withColumn("__text", F.concat_ws(" | ", *told)).where(F.length("__text") >= least)
    people = F.slice(F.array_sort(F.array_distinct(F.concat("organizations", "persons"))), 1, 10)
    category = F.when(F.size("__found") > 0, "adverse_media").otherwise("news_article")
    about = {"themes": F.array_join("themes", ";"), "organizations": F.array_join("organizations", ";"), "country": filled(df, ["country"])}
    return rows.select(*sample(F.col("__text"), "gdelt", F.concat(F.lit("gdelt_"), F.col(id)), category, F.lit("unknown"), about, entities=people, typologies=F.col("themes"), indicators=F.col("__found")))


def payment_notes(df: DataFrame, id: str, keep_sensitive: bool = False) -> DataFrame:
    """Payment notes of 2 to 500 characters, white space as single spaces; sensitive ones are dropped unless kept."""
    note = F.trim(F.regexp_replace(filled(df, ["note", "message", "description"]), r"\s+", " "))
    rows = df.withColumn("__note", note).where(F.length("__note").between(*NOTE_LENGTH)).withColumns({"__groups": T.any_tags(F.col("__note"), T.PAYMENTS), "__sensitive": T.any_tags(F.col("__note"), T.SENSITIVE)})
    if not keep_sensitive:
        rows = rows.where(F.size("__sensitive") == 0)
    date = filled(df, ["date", "created_time", "datetime"])
    when = F.coalesce(*[F.try_to_timestamp(F.substring(date, 1, 19), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")])
    about = {
        "amount": readers.amount(F.col("amount").cast("string")) if "amount" in df.columns else F.lit(None).cast("double"),
        "word_count": F.size(T.words(F.col("__note"))),
        "has_emoji": E.has_emoji(F.col("__note")),
        "sensitive": F.array_join("__sensitive", ","),
        "timestamp": when,
    }
    return rows.select(*sample(F.col("__note"), "venmo_notes", F.concat(F.lit("venmo_"), F.col(id)), F.lit("payment_memo"), F.lit("unknown"), about, typologies=F.col("__groups")))


def narratives(df: DataFrame, id: str, least: int = 50) -> DataFrame:
    """Reports of transactions: the first narrative column that is not blank, whatever its case, else all fields as key: value."""
    low = {c.lower(): c for c in df.columns}
    told = filled(df, [low[c] for c in NARRATIVE_COLUMNS if c in low])
    fields = [F.concat(F.lit(f"{c}: "), F.nullif(F.trim(_field(c).cast("string")), F.lit(""))) for c in df.columns if c != id]
    text = F.coalesce(told, F.concat_ws(" | ", *fields))
    amount = readers.amount(_field(low["amount"]).cast("string")) if "amount" in low else F.lit(None).cast("double")
    when = readers.any_date(_field(low["date"]).cast("string")) if "date" in low else F.lit(None).cast("timestamp")
    rows = df.select(F.col(id).alias("__id"), text.alias("text"), amount.alias("__amount"), when.alias("__date"), filled(df, [low[c] for c in ("filing_reason", "reason") if c in low]).alias("__reason")).where(F.length("text") >= least)
    about = {"amount": F.col("__amount"), "date": F.col("__date"), "reason": F.col("__reason")}
    t = F.col("text")
    return rows.select(*sample(t, "fincen_files", F.concat(F.lit("fincen_"), F.col("__id")), F.lit("sar_narrative"), F.lit("suspicious"), about, entities=T.entities(t), typologies=T.tags(t, T.TYPOLOGIES), indicators=T.phrases(t, T.INDICATORS)))


def sniffed_separator(spark, path: str) -> str:
    """A comma if the first line has one, else a tab."""
    first = spark.read.text(path).limit(1).collect()
    return "," if not first or "," in first[0].value else "\t"


def require_files(spark, paths: list[str]) -> None:
    """A FileNotFoundError that lists all paths that no store has."""
    missing = []
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            missing.append(p)
    if missing:
        raise FileNotFoundError(", ".join(missing))


# Filters of samples


def text_length(low: int = 10, high: int = 50_000) -> Column:
    return F.length("text").between(low, high)


def in_categories(required: list[str] | None = None, excluded: list[str] | None = None, labels: list[str] | None = None) -> Column:
    """Rows of a required category and label, and of none that is excluded; without a list all pass."""
    keep = F.lit(True)
    if required:
        keep = keep & F.col("category").isin(required)
    if excluded:
        keep = keep & ~F.col("category").isin(excluded)
    return keep & F.col("label").isin(labels) if labels else keep


def has_typology(name: str) -> Column:
    return F.array_contains("typologies", name)


def reason_contains(part: str) -> Column:
    return F.contains(F.lower(F.col("metadata")["reason"]), F.lit(part.lower()))


def amount_at_least(least: float = 1e6) -> Column:
    return F.coalesce(F.col("metadata")["amount"].cast("double") >= least, F.lit(False))


def in_country(name: str) -> Column:
    return F.exists(F.split(F.col("metadata")["countries"], ","), lambda c: F.contains(F.lower(c), F.lit(name.lower())))


def actions_between(low: int, high: int) -> Column:
    return F.col("metadata")["action_count"].cast("int").between(low, high)


def any_alias(df: DataFrame, names: list[str]) -> Column:
    """Whether any of the flags that the table has is set."""
    have = [F.coalesce(_field(n).cast("double") > 0, F.lit(False)) for n in _present(df, names)]
    out = F.lit(False)
    for flag in have:
        out = out | flag
    return out


def training_format(df: DataFrame, more: list[str] | None = None) -> DataFrame:
    return df.select("text", "label", "category", "source", *(more or []))


def risk_level(label: Column) -> Column:
    return F.when(label.isin("fraud", "illicit"), "high").when(label == "suspicious", "medium").when(label.isin("non_fraud", "licit"), "low").otherwise("unknown")


def v2_format(df: DataFrame) -> DataFrame:
    """Nested labels, entities without blanks, and counts merged into the metadata."""
    counts = F.map_from_arrays(F.array(F.lit("char_count"), F.lit("word_count")), F.array(F.length("text").cast("string"), F.size(T.words(F.col("text"))).cast("string")))
    own = F.map_filter("metadata", lambda k, _: ~k.isin("char_count", "word_count"))
    labels = F.struct(F.col("label").alias("primary"), risk_level(F.col("label")).alias("risk_level"), "typologies", "indicators")
    entities = F.when(F.size("entities") > 0, F.col("entities")).otherwise(F.array(F.lit("unknown")))
    return df.select("sample_id", "text", "source", "category", labels.alias("labels"), entities.alias("entities"), F.map_concat(own, counts).alias("metadata"))


for _name, _loader in {"sec_fraud": sec_fraud, "edgar": edgar, "fraudnlp": fraud_actions, "opensanctions": watch_list, "gdelt": articles, "venmo": payment_notes, "fincen": narratives}.items():
    readers.READERS[_name] = _loader
