"""Choice of the relevant parts of an extracted document, flags and sizes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.config import DEFAULTS
from matchloom.functions.text import strip

# Phrases of section titles, words of tables, and patterns of the flags.
SECTION_PHRASES = [
    "executive summary", "company overview", "about us", "about the company", "who we are", "our company",
    "capabilities", "core capabilities", "our capabilities", "services", "our services", "service offerings", "solutions",
    "past performance", "project experience", "experience", "our experience", "track record", "case studies",
    "client list", "our clients", "customers", "certifications", "accreditations", "compliance",
    "key personnel", "leadership", "management team", "our team", "qualifications", "technical qualifications",
    "expertise", "domain expertise", "specializations", "industries", "sectors", "markets",
    "technologies", "technical capabilities", "infrastructure", "resources", "achievements", "awards", "recognition",
]
TABLE_WORDS = ["project", "client", "contract", "value", "certification", "iso", "cmmi", "capability", "service", "technology", "experience", "year", "duration"]
ISO_PATTERNS = ["iso 9001", "iso 27001", "iso 14001", "iso certified", "iso certification"]
CMMI_PATTERNS = ["cmmi level", "cmmi-dev", "cmmi maturity", "capability maturity"]
GOVERNMENT_PATTERNS = ["government", "ministry", "department of", "public sector", "central government", "state government", "psu", "cpse"]
LARGE_PATTERNS = ["enterprise", "multinational", "global"]
MEDIUM_PATTERNS = ["mid-size", "medium"]
SMALL_PATTERNS = ["startup", "small business"]


def any_of(text: Column, words: list[str]) -> Column:
    """True if any of the words stands in the text."""
    found = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(text, F.lit(word))
    return found


def normal_title(title: Column) -> Column:
    """Lower-case letters, digits and white space of a title."""
    return strip(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", ""))


def title_is_relevant(title: Column) -> Column:
    """True if a phrase stands in the normalised title."""
    return any_of(normal_title(title), SECTION_PHRASES)


def table_is_relevant(table: Column) -> Column:
    """True if a word stands in the table's text; false for null."""
    return F.coalesce(any_of(F.lower(table), TABLE_WORDS), F.lit(False))


def combined_text(text: Column, tables: Column) -> Column:
    """The text, then each table on a line of its own."""
    parts = F.concat(F.array(F.coalesce(text, F.lit(""))), F.transform(F.coalesce(tables, F.array().cast("array<string>")), lambda x: strip(F.coalesce(x, F.lit("")))))
    return strip(F.array_join(F.filter(parts, lambda x: x != ""), "\n"))


def relevant_text(text: Column, sections: Column, tables: Column, most: int = DEFAULTS.relevant_chars, pages: int = DEFAULTS.first_pages, most_tables: int = DEFAULTS.relevant_tables, least_table: int = DEFAULTS.least_table_chars) -> Column:
    """First pages, relevant sections that do not stand there already, and relevant tables, up to ``most`` characters."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, pages)
    sections = F.filter(F.coalesce(sections, F.array().cast("array<struct<title:string,text:string>>")), lambda s: s["title"].isNotNull() & (s["title"] != "") & title_is_relevant(s["title"]) & s["text"].isNotNull() & (s["text"] != "") & ~F.contains(head, s["text"]))
    bodies = F.transform(sections, lambda s: F.concat(F.lit("\n### "), s["title"], F.lit("\n"), s["text"]))
    kept = F.filter(F.coalesce(tables, F.array().cast("array<string>")), lambda t: table_is_relevant(t) & (F.length(strip(t)) > least_table))
    rows = F.transform(F.slice(kept, 1, most_tables), lambda t: F.concat(F.lit("\n[Table]\n"), strip(t)))
    rows = F.when(F.size(rows) > 0, F.concat(F.array(F.lit("\n\n--- Tables ---\n")), rows)).otherwise(rows)
    first = F.when(head != "", F.array(head)).otherwise(F.array().cast("array<string>"))
    whole = F.array_join(F.concat(first, bodies, rows), "\n\n")
    cut = F.substring(whole, 1, most)
    period = F.length(cut) - F.instr(F.reverse(cut), ".") + 1
    ended = F.when((F.instr(cut, ".") > 0) & (period - 1 > most * 0.8), F.substr(cut, F.lit(1), period)).otherwise(cut)
    return strip(F.when(F.length(whole) > most, ended).otherwise(whole))


def key_info(text: Column) -> dict[str, Column]:
    """Flags and the size that a text speaks of."""
    low = F.lower(F.coalesce(text, F.lit("")))
    size = F.when(any_of(low, LARGE_PATTERNS), "large").when(any_of(low, MEDIUM_PATTERNS), "medium").when(any_of(low, SMALL_PATTERNS), "small")
    return {"has_iso_certification": any_of(low, ISO_PATTERNS), "has_cmmi_certification": any_of(low, CMMI_PATTERNS), "has_government_experience": any_of(low, GOVERNMENT_PATTERNS), "company_size_indicator": size}


def extraction_stats(original: Column, extracted: Column) -> dict[str, Column]:
    """Characters before and after, the share left out, and pages of 3,000 characters."""
    a, b = F.length(F.coalesce(original, F.lit(""))).cast("long"), F.length(F.coalesce(extracted, F.lit(""))).cast("long")
    return {"original_chars": a, "extracted_chars": b, "reduction_ratio": F.round(1 - b / F.greatest(a, F.lit(1).cast("long")), 2), "original_pages": F.floor(a / 3000), "extracted_pages": F.floor(b / 3000)}


def without_fences(answer: Column) -> Column:
    """JSON without the code fence around it."""
    return strip(F.regexp_replace(strip(answer), r"^```[^\n]*\n|\n?```[^\n]*$", ""))
