"""Structured profiles from the answers of an extractor, which may wrap JSON in a code fence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import profiles
from matchloom.functions.extract import without_fences

LISTS = ["industries", "capabilities", "certifications", "project_types", "past_clients", "geographic_focus", "key_technologies", "domain_expertise", "notable_projects"]
SHAPE = "company_name string, industries array<string>, capabilities array<string>, certifications array<string>, project_types array<string>, past_clients array<string>, geographic_focus array<string>, company_size string, key_technologies array<string>, domain_expertise array<string>, years_of_experience string, notable_projects array<string>, summary string"


def processed(answers: DataFrame) -> DataFrame:
    """``answers(file_hash, answer)`` as profiles with their searchable text and metadata; ``success`` is false where no profile could be read."""
    rows = answers.select("file_hash", parsed_profile(F.col("answer")).alias("profile_data"))
    success = F.col("profile_data").isNotNull()
    metadata = F.struct(*[c.alias(n) for n, c in profiles.flags("profile_data").items()])
    return rows.select("file_hash", success.alias("success"), "profile_data", F.when(success, profiles.searchable_text("profile_data")).alias("searchable_text"), F.when(success, metadata).alias("filter_metadata"))


def parsed_profile(answer: Column) -> Column:
    """The profile in an answer; null if it is no JSON object. A field that is no list where one is due is null."""
    text = without_fences(answer)
    whole = F.try_parse_json(text)
    parts = [F.try_variant_get(whole, f"$.{name}", kind).alias(name) for name, _, kind in (x.partition(" ") for x in SHAPE.split(", "))]
    return F.when(F.schema_of_variant(whole).startswith("OBJECT"), F.struct(*parts))
