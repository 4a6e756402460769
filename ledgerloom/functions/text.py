"""Column functions on text: cleaning, keys, tags, chunks. Everything stays in the JVM."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Boilerplate patterns by kind of source.
HTML = [r"<[^>]+>", r"&[a-zA-Z]+;", r"&\#\d+;", r"<!\-\-.*?\-\->", r"<script\b[^<]*(?:(?!<\/script>)<[^<]*)*<\/script>", r"<style\b[^<]*(?:(?!<\/style>)<[^<]*)*<\/style>"]
WHITESPACE = [(r"\n{3,}", "\n\n"), (r" {2,}", " "), (r"\t+", " "), (r"^\s+", ""), (r"\s+$", "")]
SEC_HEADER = [
    r"ACCESSION\s+NUMBER[:\s]+[\d\-]+",
    r"CONFORMED\s+SUBMISSION\s+TYPE[:\s]+\S+",
    r"FILED\s+AS\s+OF\s+DATE[:\s]+\d+",
    r"DATE\s+AS\s+OF\s+CHANGE[:\s]+\d+",
    r"CENTRAL\s+INDEX\s+KEY[:\s]+\d+",
    r"STANDARD\s+INDUSTRIAL\s+CLASSIFICATION[:\s]+.+",
    r"IRS\s+NUMBER[:\s]+[\d\-]+",
    r"STATE\s+OF\s+INCORPORATION[:\s]+\w+",
    r"FISCAL\s+YEAR\s+END[:\s]+\d+",
    r"FILER[:\s]*$",
    r"COMPANY\s+CONFORMED\s+NAME[:\s]+.+",
    r"<SEC-DOCUMENT>.*?</SEC-DOCUMENT>",
    r"<SEC-HEADER>.*?</SEC-HEADER>",
    r"-----BEGIN\s+PRIVACY-ENHANCED\s+MESSAGE-----.*?-----END\s+PRIVACY-ENHANCED\s+MESSAGE-----",
]
SEC_EXHIBIT = [r"EXHIBIT\s+\d+[\.\d]*", r"EX-\d+[\.\d]*", r"See\s+Exhibit\s+\d+", r"Incorporated\s+by\s+reference\s+to\s+Exhibit", r"\*+\s*Filed\s+herewith"]
SEC_CONTENTS = [r"TABLE\s+OF\s+CONTENTS", r"INDEX\s+TO\s+FINANCIAL\s+STATEMENTS", r"\.{3,}\s*\d+\s*$", r"Page\s+\d+\s+of\s+\d+"]
NEWS_CALLS = [
    r"Subscribe\s+to\s+(?:our\s+)?newsletter",
    r"Sign\s+up\s+for\s+(?:our\s+)?(?:daily|weekly|free)\s+(?:email|newsletter)",
    r"Get\s+the\s+latest\s+(?:news|updates)",
    r"Follow\s+us\s+on\s+(?:Twitter|Facebook|Instagram|LinkedIn)",
    r"Share\s+this\s+(?:article|story|post)",
    r"Like\s+us\s+on\s+Facebook",
    r"Join\s+our\s+(?:community|mailing\s+list)",
    r"Click\s+here\s+to\s+(?:subscribe|sign\s+up|learn\s+more)",
    r"Read\s+more\s+(?:articles|stories)\s+like\s+this",
    r"Recommended\s+for\s+you",
    r"You\s+may\s+also\s+like",
    r"Related\s+(?:articles|stories|posts)",
]
NEWS_COOKIES = [
    r"(?:We\s+use\s+)?cookies\s+to\s+(?:improve|enhance)",
    r"By\s+(?:continuing|using)\s+(?:this\s+site|to\s+browse)",
    r"Accept\s+(?:all\s+)?cookies",
    r"Cookie\s+(?:policy|settings|preferences)",
    r"Privacy\s+(?:policy|notice|settings)",
    r"GDPR\s+(?:compliance|notice)",
    r"(?:Your|Our)\s+privacy\s+(?:matters|is\s+important)",
]
NEWS_SOCIAL = [
    r"\[?\s*(?:Share|Tweet|Pin|Email|Print)\s*\]?",
    r"(?:Facebook|Twitter|LinkedIn|Pinterest|Reddit|WhatsApp)\s*(?:Share|Icon)?",
    r"\d+\s+(?:shares?|likes?|comments?|views?)",
    r"(?:Share|Tweet|Post)\s+this\s+(?:article|story)",
]
EMAIL_SIGNATURE = [
    r"(?:Best|Kind|Warm)\s+(?:regards|wishes)",
    r"Sincerely(?:\s+yours)?",
    r"(?:Yours\s+)?(?:truly|faithfully)",
    r"Sent\s+from\s+my\s+(?:iPhone|iPad|Android|BlackBerry)",
    r"Get\s+Outlook\s+for\s+(?:iOS|Android)",
    r"This\s+email\s+and\s+any\s+attachments?\s+(?:are|is)\s+confidential",
    r"CONFIDENTIALITY\s+NOTICE",
    r"DISCLAIMER[:\s]",
    r"This\s+message\s+(?:is\s+)?intended\s+(?:only\s+)?for",
    r"If\s+you\s+(?:are\s+not|have\s+received)\s+(?:the\s+intended|this)",
]
LEGAL = [
    r"(?:All\s+)?rights?\s+reserved",
    r"Copyright\s*[©\(c\)]\s*\d{4}",
    r"Terms\s+(?:of\s+(?:service|use)|and\s+conditions)",
    r"(?:Privacy|Cookie)\s+policy",
    r"No\s+(?:part\s+of\s+this|reproduction)",
    r"(?:Written|Prior)\s+permission\s+(?:of\s+the\s+)?(?:author|publisher)",
    r"The\s+(?:views|opinions)\s+expressed\s+(?:herein|in\s+this)",
    r"(?:This|The)\s+(?:information|content)\s+(?:is\s+)?provided\s+(?:as\s+is|for\s+informational)",
    r"(?:We|The\s+company)\s+(?:make|makes)\s+no\s+(?:warranties?|representations?)",
]

# What texts are tagged by.
TYPOLOGIES = {
    "layering": r"\b(layer(?:ing)?|multiple\s+transfers?|chain\s+of\s+transactions?)\b",
    "structuring": r"\b(structur(?:ing|ed)?|smurfing|split(?:ting)?\s+transactions?)\b",
    "shell_company": r"\b(shell\s+compan(?:y|ies)|offshore\s+entit(?:y|ies)|nominee)\b",
    "round_tripping": r"\b(round[- ]?trip(?:ping)?|circular\s+flow)\b",
    "trade_based": r"\b(trade[- ]?based|over[- ]?invoic(?:ing|ed)|under[- ]?invoic(?:ing|ed))\b",
    "cash_intensive": r"\b(cash[- ]?intensive|currency\s+exchange|money\s+service)\b",
    "high_risk_jurisdiction": r"\b(high[- ]?risk\s+(?:jurisdiction|countr(?:y|ies))|offshore)\b",
    "rapid_movement": r"\b(rapid(?:ly)?\s+(?:mov(?:ed?|ing)|transfer(?:red)?)|quick\s+succession)\b",
    "correspondent_banking": r"\b(correspondent\s+bank(?:ing)?|nested\s+account)\b",
    "pep": r"\b(p\.?e\.?p\.?|politically\s+exposed|government\s+official)\b",
}
#: By pattern, texts of which each match holds one: they are sought before the pattern is, as that costs far less.
HINTS = {
    TYPOLOGIES["layering"]: ["layer", "multiple", "chain"],
    TYPOLOGIES["structuring"]: ["structur", "smurfing", "split"],
    TYPOLOGIES["shell_company"]: ["shell", "offshore", "nominee"],
    TYPOLOGIES["round_tripping"]: ["round", "circular"],
    TYPOLOGIES["trade_based"]: ["trade", "invoic"],
    TYPOLOGIES["cash_intensive"]: ["cash", "currency", "money"],
    TYPOLOGIES["high_risk_jurisdiction"]: ["high", "offshore"],
    TYPOLOGIES["rapid_movement"]: ["rapid", "quick"],
    TYPOLOGIES["correspondent_banking"]: ["correspondent", "nested"],
    TYPOLOGIES["pep"]: ["pep", "p.e", "pe.p", "politically", "government"],
}
INDICATORS = [
    "no apparent business purpose",
    "unusual pattern",
    "suspicious activity",
    "inconsistent with",
    "no legitimate",
    "potential money laundering",
    "high-risk",
    "lacks economic purpose",
    "rapid movement",
    "unknown beneficial owner",
    "anonymous",
    "complex structure",
    "shell company",
    "nominee",
]
KEYWORDS = {
    "layering": ["layering", "layers", "multiple transfers", "chain of transactions", "complex web"],
    "structuring": ["structuring", "smurfing", "split transactions", "below threshold", "multiple deposits"],
    "trade_based": ["trade-based", "trade based", "tbml", "over-invoicing", "under-invoicing", "phantom shipments"],
    "shell_company": ["shell company", "shell companies", "nominee", "front company", "paper company"],
    "cash_intensive": ["cash-intensive", "cash intensive", "currency exchange", "money service business"],
    "real_estate": ["real estate", "property", "real property", "land transactions"],
    "cryptocurrency": ["cryptocurrency", "virtual currency", "bitcoin", "crypto assets", "digital assets"],
    "correspondent_banking": ["correspondent banking", "nested accounts", "payable-through"],
    "hawala": ["hawala", "informal value transfer", "ivts", "alternative remittance"],
    "pep": ["politically exposed", "pep", "government official", "public official"],
    "terrorist_financing": ["terrorist financing", "terrorism", "tf", "terrorist organization"],
    "sanctions_evasion": ["sanctions", "embargo", "ofac", "sanctions evasion"],
}
RED_FLAGS = [
    r"red\s+flag[s]?",
    r"indicator[s]?\s+(?:of|for)",
    r"warning\s+sign[s]?",
    r"suspicious\s+(?:activity|transaction|behavior)",
    r"unusual\s+(?:pattern|activity|transaction)",
    r"inconsistent\s+with",
    r"no\s+(?:apparent|legitimate|economic)\s+(?:purpose|reason)",
    r"lack[s]?\s+(?:of\s+)?(?:documentation|transparency)",
    r"complex\s+(?:structure|arrangement)",
    r"rapid\s+(?:movement|transfer)",
]
FRAUD_LANGUAGE = [
    r"\b(aggressively|significantly|substantially)\s+grow",
    r"\b(extraordinary|exceptional|unprecedented)\s+(?:results|performance|growth)",
    r"\bwe\s+(?:believe|expect|anticipate)\s+(?:strong|significant|substantial)",
    r"\b(may|might|could)\s+(?:not\s+)?(?:be\s+)?(?:able|possible)",
    r"\b(?:subject\s+to|depending\s+on)\s+(?:various|certain|numerous)",
    r"\b(?:due\s+to|because\s+of|as\s+a\s+result\s+of)\s+(?:market|economic|industry)",
    r"\b(?:complex|complicated|sophisticated)\s+(?:structure|arrangement|transaction)",
    r"\b(?:off[- ]?balance[- ]?sheet|special[- ]?purpose)",
]
RISKS = {
    "litigation": r"\b(litigation|lawsuit|legal\s+(?:action|proceeding)|class\s+action)\b",
    "investigation": r"\b(investigation|inquiry|subpoena|sec\s+(?:inquiry|investigation))\b",
    "restatement": r"\b(restat(?:e|ed|ement)|correct(?:ed|ion)|material\s+weakness)\b",
    "going_concern": r"\b(going\s+concern|substantial\s+doubt|ability\s+to\s+continue)\b",
    "internal_control": r"\b(internal\s+control|material\s+weakness|significant\s+deficiency)\b",
}
PAYMENTS = {
    "rent": [r"\brent\b", r"\broommate\b", r"\bapartment\b", r"\bhousing\b"],
    "food": [r"\bfood\b", r"\bdinner\b", r"\blunch\b", r"\bbreakfast\b", r"\bcoffee\b", r"\bpizza\b"],
    "utilities": [r"\butilities?\b", r"\belectric\b", r"\bgas\b", r"\binternet\b", r"\bwifi\b"],
    "transportation": [r"\buber\b", r"\blyft\b", r"\bgas\b", r"\bparking\b", r"\btransit\b"],
    "entertainment": [r"\bconcert\b", r"\bmovie\b", r"\bticket\b", r"\bshow\b", r"\bgame\b"],
    "shopping": [r"\bshopping\b", r"\bgroceries?\b", r"\bclothes\b"],
    "services": [r"\bhaircut\b", r"\bnails\b", r"\bmassage\b", r"\bgym\b"],
    "gifts": [r"\bbirthday\b", r"\bgift\b", r"\bpresent\b"],
    "alcohol": [r"\bdrinks?\b", r"\bbar\b", r"\bbeer\b", r"\bwine\b"],
    "travel": [r"\btrip\b", r"\bhotel\b", r"\bflight\b", r"\bvacation\b", r"\bairbnb\b"],
}
SENSITIVE = {
    "health": [r"\bdoctor\b", r"\bmedical\b", r"\bprescription\b", r"\btherapy\b", r"\bmental\b"],
    "legal": [r"\blawyer\b", r"\blegal\b", r"\bcourt\b", r"\bbail\b"],
    "adult": [r"\b18\+", r"\badult\b"],
    "drugs": [r"\b420\b", r"\bweed\b"],
    "gambling": [r"\bbet\b", r"\bpoker\b", r"\bcasino\b"],
}


def _literal(pattern: str) -> str:
    """The text that each match of a word pattern holds: without boundaries and without a last letter that may be missing."""
    return re.sub(r".\?", "", pattern.replace(r"\b", "")).replace("\\+", "+")


#: Of words by name, one pattern a name (``any_tags``): each is a literal, so it is its own hint.
HINTS |= {"|".join(p): [_literal(x) for x in p] for p in (*PAYMENTS.values(), *SENSITIVE.values())}


def replace_all(text: Column, patterns: list[str], flags: str = "(?is)", by: str = " ") -> Column:
    """Patterns replaced one after the other, in order."""
    for p in patterns:
        text = F.regexp_replace(text, flags + p, by)
    return text


def unescape(text: Column) -> Column:
    """The five predefined entities; other named ones are blanked beforehand."""
    for entity, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(value))
    return text


def strip_html(text: Column, mode: str = "compat") -> Column:
    """Tags, entities and comments become spaces.

    ``compat`` keeps the usual order, in which tags go first, so that script bodies survive;
    ``strict`` removes scripts, styles and comments first and keeps the five predefined entities.
    """
    if mode == "compat":
        return replace_all(text, HTML)
    out = replace_all(text, [r"<script\b.*?</script\s*>", r"<style\b.*?</style\s*>", r"<!--.*?-->", r"<[^>]+>"])
    return replace_all(unescape(out), [r"&[a-zA-Z]+;", r"&#\d+;"])


def normalize_whitespace(text: Column) -> Column:
    for p, by in WHITESPACE:
        text = F.regexp_replace(text, "(?m)" + p, by)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_lines(text: Column, patterns: list[str]) -> Column:
    """Lines in which any pattern is found are dropped: one alternation over each line."""
    any_of = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(any_of)), "\n")


def clean_sec(text: Column) -> Column:
    out = replace_all(strip_html(text), SEC_HEADER, "(?im)", "")
    return normalize_whitespace(strip_lines(strip_lines(out, SEC_EXHIBIT), SEC_CONTENTS))


def clean_news(text: Column) -> Column:
    out = strip_lines(strip_html(text), NEWS_CALLS)
    return normalize_whitespace(replace_all(out, [*NEWS_COOKIES, *NEWS_SOCIAL], "(?i)", ""))


def clean_email(text: Column) -> Column:
    return normalize_whitespace(strip_lines(strip_lines(text, EMAIL_SIGNATURE), LEGAL))


def clean_general(text: Column, html: bool = True, legal: bool = True) -> Column:
    out = strip_html(text) if html else text
    return normalize_whitespace(strip_lines(out, LEGAL) if legal else out)


def clean_by_source(text: Column, source: Column) -> Column:
    return (
        F.when(source == "sec_edgar", clean_sec(text))
        .when(source == "gdelt", clean_news(text))
        .when(source == "venmo_notes", clean_general(text, html=False))
        .otherwise(clean_general(text))
    )


def dedup_key_text(text: Column) -> Column:
    """Lower case, white space runs as one space, ends trimmed; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def words(text: Column) -> Column:
    """Words between white space; none for a blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def char_shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of k characters; a shorter text is its own. Characters are split once and zipped with their successors."""
    c = F.split(text, "")
    return F.when(F.length(text) < k, F.array(text)).otherwise(_runs(c, k, ""))


def word_shingles(text: Column, k: int = 3) -> Column:
    """Distinct runs of k words; a shorter text is its own. Lambdas hold the text and its words, which would else be made anew for each use."""
    runs = lambda t, w: F.when(F.size(w) < k, F.array(t)).otherwise(_runs(w, k, " "))
    of = lambda t: F.transform(F.array(words(t)), lambda w: runs(t, w))[0]
    return F.transform(F.array(text), of)[0]


def _runs(items: Column, k: int, by: str) -> Column:
    """A lambda that slices ``items`` at each position would evaluate them anew each time; zipped slices cost k passes."""
    n = F.greatest(F.size(items) - k + 1, F.lit(0))
    zipped = F.arrays_zip(*[F.slice(items, i + 1, n).alias(f"s{i}") for i in range(k)])
    return F.array_distinct(F.transform(zipped, lambda z: F.concat_ws(by, *[z[f"s{i}"] for i in range(k)])))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def found(low: Column, pattern: str) -> Column:
    """Whether a pattern is found in a text in lower case, behind a look for its hints."""
    hints = [F.contains(low, F.lit(h)) for h in HINTS.get(pattern, [])]
    return functools.reduce(lambda a, b: a | b, hints) & low.rlike(pattern) if hints else low.rlike(pattern)


def lowered(text: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of the text in lower case. A one-element array binds that text, which else would be made anew for every use."""
    return F.transform(F.array(F.lower(text)), use)[0]


def tags(text: Column, patterns: dict[str, str]) -> Column:
    """Names whose pattern is found, in declared order."""
    return lowered(text, lambda low: F.array_compact(F.array(*[F.when(found(low, p), F.lit(n)) for n, p in patterns.items()])))


def any_tags(text: Column, patterns: dict[str, list[str]]) -> Column:
    return tags(text, {n: "|".join(p) for n, p in patterns.items()})


def phrases(text: Column, known: list[str]) -> Column:
    return lowered(text, lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in known])))


def keyword_tags(text: Column, known: dict[str, list[str]]) -> Column:
    any_of = lambda low, ks: functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in ks])
    return lowered(text, lambda low: F.array_compact(F.array(*[F.when(any_of(low, ks), F.lit(n)) for n, ks in known.items()])))


def matched(text: Column, patterns: list[str]) -> Column:
    """Distinct matched strings of all patterns, sorted."""
    return lowered(text, lambda low: F.array_sort(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in patterns])))))


def found_patterns(text: Column, patterns: list[str]) -> Column:
    return lowered(text, lambda low: F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(p)) for p in patterns])))


def pattern_counts(text: Column, patterns: dict[str, str]) -> Column:
    """Map of how often each pattern is found, those that are."""
    counts = lowered(text, lambda low: F.create_map(*[x for n, p in patterns.items() for x in (F.lit(n), F.regexp_count(low, F.lit(p)))]))
    return F.map_filter(counts, lambda _, v: v > 0)


def entities(text: Column, most: int = 20) -> Column:
    """Quoted names, banks and companies, distinct and sorted, the first ``most``."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)),
        F.regexp_extract_all(text, F.lit(r"(\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+Bank\b)"), F.lit(1)),
        F.regexp_extract_all(text, F.lit(r"(\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s+(?:LLC|Ltd|Inc|Corp|Limited)\b)"), F.lit(1)),
    )
    return F.slice(F.array_sort(F.array_distinct(found)), 1, most)


def chunk_starts(n: Column, size: int = 512, overlap: int = 64) -> Column:
    """Starts (from 0) of word chunks: one up to ``size`` words, else every size - overlap words until the rest is covered."""
    step = size - overlap
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def sample_id(source: Column, text: Column) -> Column:
    return F.concat(source, F.lit("_"), F.substring(F.md5(text), 1, 12))


# What wrongly decoded text has in place of quotes, and what is dropped.
MOJIBAKE = [("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("Â", ""), ("\x00", "")]


def fix_encoding(text: Column) -> Column:
    for old, new in MOJIBAKE:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unicode_form(accents: bool):
    """A pandas UDF: compatibility composition, and marks stripped if asked for; no built-in function has either."""
    def form(texts: pd.Series) -> pd.Series:
        import unicodedata

        def one(t: str | None) -> str | None:
            if t is None or t.isascii():
                return t
            t = unicodedata.normalize("NFKC", t)
            return "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn") if accents else t

        return texts.map(one, na_action="ignore")

    return F.pandas_udf(form, "string")


def normalize_full(text: Column, *, lower: bool = True, accents: bool = True) -> Column:
    """Encoding mended, one Unicode form, accents stripped, lower case, white space normalised."""
    out = unicode_form(accents)(fix_encoding(text))
    return normalize_whitespace(F.lower(out) if lower else out)
