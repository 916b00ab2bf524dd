"""Problem 2: freely typed values mapped to the entries of a reference list.

Method: the distinct tokens of the values are joined to the tokens of the reference forms of their kind (canonical names and
short forms) by edit distance, insertions, deletions, replacements and swaps of neighbours counting one each (two swaps in a
word at most). The join goes by deletion neighbourhoods: two tokens within ``EDITS`` edits agree in a string that is left when
so many letters at most are deleted from the first ``PREFIX`` of each. Entries all of whose tokens are met, numbers exactly,
within a budget of edits that grows with their length, are ranked by soft TF-IDF: the sum over the corrected tokens of their
weight in the value, their weight in the form and their likeness, with both weights of unit length. A value and a form
without white space count as one token more, which finds values run together or spelled letter by letter.

Defined cases: null and blank values are not listed; a value without letters or digits, or with no form near enough, gets
-1; equal scores go to the fewer edits and then to the lower id; repeated rows count once; a list with no entry of a kind
leaves its values unmatched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import materialise, stored, table

#: Path of each field and the kind of its entries.
FIELDS = {
    "profile_data.industries": "industry",
    "profile_data.certifications": "certification",
    "profile_data.past_clients": "client",
    "profile_data.geographic_focus": "place",
    "profile_data.key_technologies": "technology",
    "filter_metadata.company_size": "size",
}
#: Words that carry no meaning in a name.
EMPTY_WORDS = ["a", "an", "the", "of", "and", "in", "on", "at", "near", "for", "to"]
LEAST_SCORE = 0.35
PREFIX_SIMILARITY, BARE_SIMILARITY = 0.85, 0.8
LEAST_PREFIX = 3
EDITS, PREFIX = 3, 7


def words(value: Column) -> Column:
    """Lower-case runs of letters and digits, with letters and digits apart."""
    apart = F.regexp_replace(F.lower(value), r"(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})", " ")
    return F.filter(F.split(F.regexp_replace(apart, r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def tokens(value: Column) -> Column:
    """The distinct words of a value that carry meaning; all words if none does."""
    found = words(value)
    full = F.array_except(found, F.array(*[F.lit(x) for x in EMPTY_WORDS]))
    return F.array_distinct(F.when(F.size(full) > 0, full).otherwise(found))


def whole(value: Column) -> Column:
    """The letters and digits of a value as one token, marked so that it meets only its like."""
    return F.concat(F.lit("="), F.array_join(words(value), ""))


def deletions(token: Column, most: int = EDITS, prefix: int = PREFIX) -> Column:
    """The strings left when up to ``most`` letters are deleted from the first ``prefix`` of a token."""
    whole = last = F.array(F.substring(token, 1, prefix))
    for _ in range(most):
        shorter = F.transform(last, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(prefix)))))
        last = F.array_distinct(F.flatten(shorter))
        whole = F.array_union(whole, last)
    return whole


def edits(token: Column, other: Column) -> Column:
    """Edits between two tokens, a swap of neighbours counting one; at most two swaps are looked for."""

    def swapped(x: Column, i: Column) -> Column:
        return F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1)), F.substring(x, i, F.lit(1)), F.substring(x, i + 2, F.length(x)))

    last = F.length(token) - 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    one = F.transform(places, lambda i: F.levenshtein(swapped(token, i), other) + 1)
    later = lambda i: F.when(i + 2 <= last, F.sequence(i + 2, last)).otherwise(F.array().cast("array<int>"))
    two = F.flatten(F.transform(places, lambda i: F.transform(later(i), lambda j: F.levenshtein(swapped(swapped(token, i), j), other) + 2)))
    plain = F.levenshtein(token, other)
    # a swap can pay only where plain edits count at least two
    return F.when(plain <= 1, plain).when(plain == 2, F.least(plain, F.array_min(one))).otherwise(F.least(plain, F.array_min(one), F.array_min(two)))


def room(form_token: Column) -> Column:
    """Edits that a form's token allows: none below three letters, then one for every two letters, ``EDITS`` at most."""
    n = F.length(form_token)
    return F.when(n < 3, 0).otherwise(F.least(F.lit(EDITS), F.floor((n - 1) / 2).cast("int")))


def token_matches(typed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(kind, token, form_token, edits, alike)``: the form tokens that each typed token may stand for."""
    # a form's token gives only the strings left after as many deletions as it may have edits, so that no short string gathers all
    near = vocabulary.select("kind", "form_token", F.explode(deletions(F.col("form_token"))).alias("left"))
    near = near.where(F.length("left") >= F.least(F.length("form_token"), F.lit(PREFIX)) - room(F.col("form_token")))
    met = typed.select("kind", "token", F.explode(deletions(F.col("token"))).alias("left")).join(near, ["kind", "left"]).select("kind", "token", "form_token").distinct()
    numeric = F.regexp_replace("token", r"[^\p{N}]", "") == F.regexp_replace("form_token", r"[^\p{N}]", "")
    plain = F.col("token").startswith("=") == F.col("form_token").startswith("=")
    met = met.where(numeric & plain & (F.abs(F.length("token") - F.length("form_token")) <= room(F.col("form_token"))) & (F.levenshtein("token", "form_token") <= room(F.col("form_token")) + 2))
    size = F.greatest(F.length("token"), F.length("form_token"))
    # written, so that no later filter computes the edits again
    edited = stored(met.withColumn("edits", edits(F.col("token"), F.col("form_token")))).where((F.col("edits") == 0) | ((F.col("edits") <= room(F.col("form_token"))) & ~F.col("form_token").rlike(r"^\p{N}+$")))
    edited = edited.withColumn("alike", 1 - F.col("edits") / size)
    # a shortened word: the beginnings of the form's tokens are the keys
    begun = vocabulary.where(~F.col("form_token").startswith("=") & (F.length("form_token") > LEAST_PREFIX))
    begun = begun.select("kind", "form_token", F.explode(F.transform(F.sequence(F.lit(LEAST_PREFIX), F.length("form_token") - 1), lambda n: F.substring(F.col("form_token"), F.lit(1), n))).alias("token"))
    prefixed = typed.where(~F.col("token").startswith("=") & ~F.col("token").rlike(r"\p{N}")).join(begun, ["kind", "token"])
    prefixed = prefixed.select("kind", "token", "form_token", F.lit(0).alias("edits"), F.lit(PREFIX_SIMILARITY).alias("alike"))
    # a token without vowels stands for a word that holds its letters in order, from the first to the last
    ends = lambda x: F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1)).alias("ends")
    bare = typed.where((F.length("token") >= LEAST_PREFIX) & F.col("token").rlike(r"^[^aeiou\W\d_]+$")).select("kind", "token", ends("token"))
    firsts = vocabulary.where(~F.col("form_token").startswith("=")).select("kind", "form_token", ends("form_token"))
    inside = F.expr("form_token rlike concat('^', array_join(filter(split(token, ''), x -> x <> ''), '.*'), '$')")
    bared = bare.join(firsts, ["kind", "ends"]).where(inside & (F.length("token") < F.length("form_token")))
    prefixed = prefixed.unionByName(bared.select("kind", "token", "form_token", F.lit(0).alias("edits"), F.lit(BARE_SIMILARITY).alias("alike")))
    return edited.unionByName(prefixed).groupBy("kind", "token", "form_token").agg(F.max(F.struct("alike", -F.col("edits"))).alias("best")).select("kind", "token", "form_token", (-F.col("best.col2")).alias("edits"), F.col("best.alike").alias("alike"))


def mapped(values: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct ``values(kind, raw_value)`` with ``canonical_id`` (-1: none) and ``score``, by ``entries(canonical_id, kind, canonical, short_forms)``."""
    values = materialise(values.select("kind", "raw_value").distinct())
    forms = entries.where("canonical_id is not null and kind is not null").select("canonical_id", "kind", F.explode(F.array_distinct(F.concat(F.array("canonical"), F.coalesce("short_forms", F.array())))).alias("form"))
    forms = forms.where(F.size(words(F.col("form"))) > 0).select("canonical_id", "kind", "form", F.length(F.array_join(tokens(F.col("form")), "")).alias("letters"), tokens(F.col("form")).alias("own"), whole(F.col("form")).alias("one"))
    form_tokens = forms.select("canonical_id", "kind", "form", "letters", F.size("own").alias("n"), F.explode("own").alias("form_token"))
    ones = forms.select("canonical_id", "kind", "form", "letters", F.lit(1).alias("n"), F.col("one").alias("form_token"))
    form_tokens = materialise(form_tokens.unionByName(ones).distinct())
    vocabulary = form_tokens.select("kind", "form_token").distinct()
    typed = values.select("kind", "raw_value", F.explode(F.concat(tokens(F.col("raw_value")), F.array(whole(F.col("raw_value"))))).alias("token")).where("token <> '='")
    totals = values.groupBy("kind").agg(F.count("*").alias("total"))
    weights = typed.groupBy("kind", "token").agg(F.count("*").alias("df")).join(totals, "kind").select("kind", "token", F.log(1 + F.col("total") / F.col("df")).alias("weight"))
    weights = materialise(weights)
    matches = materialise(token_matches(weights.select("kind", "token"), vocabulary))
    # a form's token weighs as the values' own spelling of it does, or as a token seen once
    form_weights = vocabulary.join(weights.withColumnRenamed("token", "form_token"), ["kind", "form_token"], "left").join(totals, "kind", "left")
    form_weights = form_weights.select("kind", "form_token", F.coalesce("weight", F.log(1 + F.coalesce("total", F.lit(1)))).alias("form_weight"))
    weighed = typed.join(weights, ["kind", "token"])
    is_whole = F.col("token").startswith("=")
    norms = weighed.where(~is_whole).groupBy("kind", "raw_value").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    held = form_tokens.join(form_weights, ["kind", "form_token"])
    one = F.col("form_token").startswith("=")
    form_norms = held.groupBy("kind", "form", "canonical_id", one.alias("one")).agg(F.sqrt(F.sum(F.col("form_weight") * F.col("form_weight"))).alias("form_norm"))
    # every form token takes its most alike typed token
    met = weighed.join(matches, ["kind", "token"]).join(held, ["kind", "form_token"])
    met = met.groupBy("kind", "raw_value", "canonical_id", "form", "letters", "n", one.alias("one"), "form_token").agg(F.max(F.struct("alike", (-F.col("edits")).alias("kept"), "weight", "form_weight")).alias("m"))
    scored = met.groupBy("kind", "raw_value", "canonical_id", "form", "letters", "n", "one").agg(
        F.count("*").alias("found"), F.sum(-F.col("m.kept")).alias("edits"), F.sum(F.col("m.alike") * F.col("m.weight") * F.col("m.form_weight")).alias("dot"),
        F.min("m.alike").alias("least"),
    )
    scored = scored.join(norms, ["kind", "raw_value"], "left").join(form_norms, ["kind", "form", "canonical_id", "one"])
    budget = F.when(F.col("letters") <= 3, 0).when(F.col("letters") <= 5, 1).when(F.col("letters") <= 7, 2).otherwise(3)
    cosine = F.col("dot") / (F.col("form_norm") * F.coalesce("norm", "form_norm"))
    score = F.when(F.col("one"), F.col("least")).otherwise(cosine)
    scored = scored.where((F.col("found") == F.col("n")) & (F.col("edits") <= budget)).withColumn("score", score).where(F.col("score") >= LEAST_SCORE)
    best = scored.groupBy("kind", "raw_value").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("edits")).alias("kept"), (-F.col("canonical_id")).alias("id"))).alias("b"))
    return values.join(best, ["kind", "raw_value"], "left").select("kind", "raw_value", F.coalesce(-F.col("b.id"), F.lit(-1)).cast("long").alias("canonical_id"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def typed_values(rows: DataFrame) -> DataFrame:
    """``(file_hash, field_name, kind, raw_value)`` of every non-blank value, each once."""
    parts = []
    for path, kind in FIELDS.items():
        value = F.explode(path) if path.startswith("profile_data") else F.col(path)
        parts.append(rows.select("file_hash", F.lit(path).alias("field_name"), F.lit(kind).alias("kind"), value.alias("raw_value")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    return every.where(F.col("file_hash").isNotNull() & F.col("raw_value").rlike(r"(?U)[^\s\x1c-\x1f]")).distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every typed value with the entry it means, or -1."""
    values = materialise(typed_values(table(spark, folder, "company_profile_embeddings")))
    known = mapped(values, table(spark, folder, "canonical_values"))
    return values.join(known, ["kind", "raw_value"]).select("file_hash", "field_name", "raw_value", "canonical_id")


def p2_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values that mean no entry, with the number of files that hold them."""
    return p2_found(spark, folder).where("canonical_id = -1").groupBy("field_name", "raw_value").agg(F.count("*").alias("n_files"))


QUERIES = {"p2_found": p2_found, "p2_unmatched": p2_unmatched}
