"""Text, flags and keywords of a structured company profile, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.extract import any_of
from matchloom.functions.text import token_set, tokenize

# Labels in their order, keyword fields, stop words, and the words of the flags.
LABELS = [
    ("Company", "company_name", ""), ("Summary", "summary", ""), ("Industries", "industries", ", "), ("Domain expertise", "domain_expertise", ", "),
    ("Capabilities", "capabilities", ", "), ("Technologies", "key_technologies", ", "), ("Project types", "project_types", ", "),
    ("Certifications", "certifications", ", "), ("Geographic focus", "geographic_focus", ", "), ("Past clients", "past_clients", ", "), ("Notable projects", "notable_projects", "; "),
]
KEYWORD_FIELDS = ["capabilities", "key_technologies", "domain_expertise", "industries", "project_types", "certifications"]
STOP_WORDS = ["and", "or", "the", "of", "in", "for", "to", "a", "an", "is", "are"]
IT_WORDS = ["it", "software", "technology", "digital"]
PAN_INDIA_WORDS = ["pan-india", "pan india", "nationwide", "all india"]
GLOBAL_WORDS = ["global", "international", "worldwide"]


def texts(profile: str, field: str) -> Column:
    """The list in a field, in lower case; empty for null, null values left out."""
    return F.transform(F.filter(F.coalesce(F.col(f"{profile}.{field}"), F.array().cast("array<string>")), lambda x: x.isNotNull()), F.lower)


def searchable_text(profile: str) -> Column:
    """Labelled lines of what the profile holds."""
    lines = []
    for label, field, joint in LABELS:
        value = F.col(f"{profile}.{field}")
        full = value != "" if not joint else F.size(value) > 0
        lines.append(F.when(full, F.concat(F.lit(f"{label}: "), value if not joint else F.array_join(value, joint))))
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")


def keywords(profile: str) -> Column:
    """Distinct values of the keyword fields and their tokens, without stop words; values of several words are kept whole too."""
    values = F.flatten(F.array(*[texts(profile, x) for x in KEYWORD_FIELDS]))
    every = F.concat(values, F.flatten(F.transform(values, tokenize)))
    return F.array_distinct(F.filter(every, lambda x: ~x.isin(STOP_WORDS)))


def _held(values: Column, words: list[str]) -> Column:
    return F.exists(values, lambda x: any_of(x, words))


def flags(profile: str) -> dict[str, Column]:
    """Metadata to filter by; words for information technology and places are looked for across the joined list."""
    certificates, industries, places = (texts(profile, x) for x in ("certifications", "industries", "geographic_focus"))
    joined = lambda values, words: _held(F.array(F.array_join(values, " ")), words)
    years = F.col(f"{profile}.years_of_experience")
    number = F.expr(f"try_cast(regexp_extract({profile}.years_of_experience, '^\\\\s*([+-]?[0-9]+)\\\\s*$', 1) as int)")
    size = F.col(f"{profile}.company_size")
    return {
        "company_size": F.when(size != "", size),
        "years_of_experience": F.when(years != "", number),
        "has_iso_9001": _held(certificates, ["iso 9001", "iso9001"]),
        "has_iso_27001": _held(certificates, ["iso 27001", "iso27001"]),
        "has_cmmi": _held(certificates, ["cmmi"]),
        "is_it_company": joined(industries, IT_WORDS),
        "is_defense": _held(industries, ["defense", "defence"]),
        "is_healthcare": _held(industries, ["health", "medical"]),
        "operates_pan_india": joined(places, PAN_INDIA_WORDS),
        "operates_global": joined(places, GLOBAL_WORDS),
    }


def explained(profile: str, text: Column, most: int = 5) -> dict[str, Column]:
    """Keywords that a text matches, each under the first class that knows it, and the strength of the match."""
    matched = F.array_sort(F.array_intersect(keywords(profile), token_set(text)))
    own = {x: F.flatten(F.transform(texts(profile, x), tokenize)) for x in ("capabilities", "key_technologies", "domain_expertise")}
    capability = F.array_intersect(matched, own["capabilities"])
    rest = F.array_except(matched, capability)
    technology = F.array_intersect(rest, own["key_technologies"])
    domain = F.array_intersect(F.array_except(rest, technology), own["domain_expertise"])
    n = F.size(matched)
    return {
        "total_matched": n,
        "capability_matches": F.array_join(F.slice(capability, 1, most), "|"),
        "technology_matches": F.array_join(F.slice(technology, 1, most), "|"),
        "domain_matches": F.array_join(F.slice(domain, 1, most), "|"),
        "match_strength": F.when(n > 10, "strong").when(n > 5, "medium").otherwise("weak"),
    }
