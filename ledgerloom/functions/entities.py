"""Column functions on watch-list entities, notes and articles: texts, risk classes, categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Risk classes by keywords, words for kinds of entities, and case-study patterns.
RISK_CLASSES = {
    "sanctions": ["OFAC", "EU", "UN", "UK sanctions"],
    "pep": ["PEP", "Politically Exposed Person", "Government Official"],
    "crime": ["Criminal", "Organized Crime", "Fraud", "Money Laundering"],
    "terrorism": ["Terrorist", "Terrorism Financing", "Terror"],
}
KIND_WORDS = {"Person": "individual", "Organization": "organization", "Company": "company", "LegalEntity": "legal entity", "PublicBody": "public body"}
STATUS_WORDS = {"sanctioned": ["sanction", "ofac", "sdn"], "politically exposed": ["pep", "politically exposed"], "associated with criminal activity": ["criminal", "crime", "fraud"]}
CASE_STUDY = [
    r"case\s+(?:study|example|no\.?\s*\d+)",
    r"example\s+\d+",
    r"scenario\s+\d+",
    r"(?:the|a)\s+(?:following|this)\s+case",
    r"in\s+this\s+(?:case|example)",
]
EMOJI = r"[\x{1F300}-\x{1F9FF}]"
#: The schema of an entity: lists are never null after ``entity_lists``.
LISTS = ["alias", "weakAlias", "country", "birthDate", "nationality", "position", "program", "topics", "notes", "summary", "description", "datasets"]


def has_emoji(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(EMOJI)


def is_case_study(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(f"(?:{p})" for p in CASE_STUDY))


def entity_lists() -> dict[str, Column]:
    """Each list column of an entity, null as empty."""
    return {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in LISTS}


def _either(a: str, *others: str) -> Column:
    out = F.col(others[-1]) if others else F.col(a)
    for c in [*reversed(others[:-1]), a] if others else []:
        out = F.when(F.size(c) > 0, F.col(c)).otherwise(out)
    return out


def _joined(x: Column, most: int | None = None) -> Column:
    return F.array_join(x if most is None else F.slice(x, 1, most), ", ")


def _part(condition: Column, *text: Column | str) -> Column:
    """The text where the condition holds, else null, which joins leave out."""
    return F.when(condition, F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]))


def _listed(label: str, x: Column, most: int | None = None, end: str = "") -> Column:
    return _part(F.size(x) > 0, label, _joined(x, most), end)


def _lower_all(*lists: str) -> Column:
    return F.lower(F.array_join(F.concat(*[F.col(c) for c in lists]), " "))


def risk_classes() -> Column:
    """array<string>: classes whose keywords occur in topics, programmes and datasets, in declared order."""
    found = _lower_all("topics", "program", "datasets")
    return F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(k.lower()) for k in ks]), lambda k: F.contains(found, k)), F.lit(n)) for n, ks in RISK_CLASSES.items()]))


def category(risks: Column) -> Column:
    return F.when(F.array_contains(risks, "pep"), "pep_profile").when(F.array_contains(risks, "sanctions"), "sanctions_reason").otherwise("entity_description")


def label(risks: Column) -> Column:
    return F.when(F.size(risks) > 0, "suspicious").otherwise("unknown")


def _kind(public: str) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in KIND_WORDS.items() for x in (k, public if k == "PublicBody" else v)])
    return F.coalesce(known[F.col("schema")], F.lit("entity"))


def _name(default: str | None) -> Column:
    names = [F.nullif(F.col(c), F.lit("")) for c in ("caption", "name")]
    return F.coalesce(*names, *([F.lit(default)] if default else []))


def simple_text() -> Column:
    """Labelled parts, joined by bars."""
    notes, description = _either("notes", "summary"), F.col("description")
    parts = [
        F.concat(F.lit("Entity: "), _name(None)),
        F.concat(F.lit("Type: "), F.nullif(F.col("schema"), F.lit(""))),
        _listed("Also known as: ", _either("alias", "weakAlias"), 5),
        _listed("Country: ", F.col("country")),
        _listed("Birth date: ", F.col("birthDate"), 1),
        _listed("Position: ", F.col("position"), 3),
        _listed("Program/Topic: ", _either("program", "topics")),
        _part(F.size(notes) > 0, "Notes: ", F.substring(F.get(notes, 0), 1, 500)),
        _part(F.size(description) > 0, "Description: ", F.substring(F.get(description, 0), 1, 500)),
    ]
    return F.concat_ws(" | ", *parts)


def enriched_text() -> Column:
    """Sentences: who, why, other names, positions, lists, notes."""
    found = F.concat(_lower_all("topics", "program"), F.lit(" "), _lower_all("datasets"))
    status = F.array_join(F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(k) for k in ks]), lambda k: F.contains(found, k)), F.lit(n)) for n, ks in STATUS_WORDS.items()])), ", ")
    where = F.coalesce(_listed("from ", F.col("country")), F.lit(""))
    main = F.concat(_name("Unknown entity"), F.lit(" is a "), F.when(status == "", "of interest").otherwise(status), F.lit(" "), _kind("public body"), F.lit(" "), where)
    notes = _either("notes", "summary")
    sentences = [
        F.concat(F.trim(main), F.lit(".")),
        _listed("Also known as: ", _either("alias", "weakAlias"), 5, "."),
        _listed("Held position(s): ", F.col("position"), 3, "."),
        _listed("Listed under: ", F.col("datasets"), 3, "."),
        _part(F.size(notes) > 0, F.substring(F.get(notes, 0), 1, 300)),
    ]
    return F.concat_ws(" ", *sentences)


def narrative_text() -> Column:
    """Paragraphs: who, where listed, notes, other names."""
    kind, topics, notes, alias = _kind("government body"), F.concat("topics", "program"), _either("notes", "summary", "description"), _either("alias", "weakAlias")
    who = F.concat_ws(". ", F.concat(_name("Unknown entity"), F.lit(" is a "), kind), _listed("associated with ", F.col("country")), _listed("born ", F.col("birthDate"), 1), _listed("with ", F.col("nationality"), None, " nationality"))
    why = F.concat_ws(". ", _part(F.size("datasets") > 0, "This ", kind, " appears in the following databases: ", _joined(F.col("datasets"), 5)), _listed("Relevant topics include: ", topics, 5))
    paragraphs = [
        F.concat(who, F.lit(".")),
        F.when((F.size("datasets") > 0) | (F.size(topics) > 0), F.concat(why, F.lit("."))),
        _part(F.size(notes) > 0, F.substring(F.get(notes, 0), 1, 500)),
        _part(F.size(alias) > 0, "This ", kind, " may also be known by the following names: ", _joined(alias, 10), "."),
    ]
    return F.concat_ws("\n\n", *paragraphs)
