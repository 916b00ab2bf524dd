"""Hybrid and single-vector retrieval for many profiles at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.config import DEFAULTS, Config
from matchloom.functions.text import filters_pass, keyword_boost, overlap_score, snippet, token_set, tokenize
from matchloom.functions.vectors import combined
from matchloom.operators.approximate import Inverted, approximately_nearest
from matchloom.operators.state import live
from matchloom.operators.vectors import fused, nearest, scored
from matchloom.session import discard, stored

Filters = dict[str, str | None]


@dataclass
class Corpus:
    """What is searched: ``chunks(id, owner, tender_id, chunk_index, document, vector)``, ``documents`` by ``_id``, ``tenders`` by ``_id``."""

    chunks: DataFrame
    documents: DataFrame
    tenders: DataFrame
    #: An inverted file over the chunks makes the search approximate, and its cost independent of most chunks.
    index: Inverted | None = None


@dataclass
class Profiles:
    """Who asks: ``vectors(profile, nth, vector)``, ``means(profile, vector)``, ``keywords(profile, keywords)``, ``queries(profile, query, vector)``."""

    vectors: DataFrame
    means: DataFrame
    keywords: DataFrame | None = None
    queries: DataFrame | None = None
    filters: Filters = field(default_factory=dict)


def _near(queries: DataFrame, chunks: DataFrame, n: int, index: Inverted | None) -> DataFrame:
    return nearest(queries, chunks, n) if index is None else approximately_nearest(queries, index, n)


def multi_vector_scores(vectors: DataFrame, chunks: DataFrame, n: int, weight: float = DEFAULTS.weight_multi, index: Inverted | None = None) -> DataFrame:
    """``(profile, id, score)``: the best weighted similarity over a profile's vectors, of the n nearest chunks of each."""
    found = _near(vectors.select(F.concat_ws("|", "nth", "profile").alias("qid"), "vector"), chunks, n, index)
    found = scored(found, weight).withColumn("profile", F.expr("substring(qid, instr(qid, '|') + 1)"))
    return fused(found.select("profile", "id", "score"), keys=["profile", "id"])


def single_vector_scores(means: DataFrame, chunks: DataFrame, n: int, weight: float, index: Inverted | None = None) -> DataFrame:
    """``(profile, id, score)`` of the n nearest chunks of each profile's single vector."""
    found = _near(means.select(F.col("profile").alias("qid"), "vector"), chunks, n, index)
    return scored(found, weight).select(F.col("qid").alias("profile"), "id", "score")


def _with_documents(found: DataFrame, corpus: Corpus, now: Column, filters: Filters) -> DataFrame:
    """Inner join to live documents, left join to their tenders, and the filters, each on any column of either, the document's first."""
    asked = [name for name, value in filters.items() if value is not None and value != ""]
    first = {n: F.col(f"_d_{n}") for n in asked if n in corpus.documents.columns}
    second = {n: F.col(f"_t_{n}") for n in asked if n in corpus.tenders.columns}
    documents = corpus.documents.select(F.col("_id").alias("owner"), "tender_id", "pdf_url", "local_path", F.col("source").alias("doc_source"), "expires_at", *[F.col(n).cast("string").alias(f"_d_{n}") for n in first]).where(live(now))
    tenders = corpus.tenders.select(F.col("_id").alias("tender_id"), "title", F.col("tender_ref_no").alias("ref_no"), "duration", *[F.col(n).cast("string").alias(f"_t_{n}") for n in second])
    joined = found.join(documents, "owner").join(tenders, "tender_id", "left")
    return joined.where(filters_pass(filters, first, second)).drop(*[f"_d_{n}" for n in first], *[f"_t_{n}" for n in second])


def hybrid(corpus: Corpus, profiles: Profiles, now: Column, k: int = 10, config: Config = DEFAULTS) -> DataFrame:
    """The k best documents of each profile: vectors and means (and queries) fused, filtered, one chunk a document, boosted.

    The k are chosen by their base score; the keyword boost only orders them.
    """
    k = max(1, k)
    parts = [multi_vector_scores(profiles.vectors, corpus.chunks, 6 * k, config.weight_multi, corpus.index), single_vector_scores(profiles.means, corpus.chunks, 2 * k, config.weight_mean, corpus.index)]
    if profiles.queries is not None:
        parts.append(single_vector_scores(profiles.queries.select("profile", "vector"), corpus.chunks, 2 * k, config.weight_query, corpus.index))
    scores = fused(*parts, keys=["profile", "id"])
    best = Window.partitionBy("profile").orderBy(F.desc("score"), "id")
    # written in steps, so that the shuffles of the search, of the documents and of the texts are not on disk at once
    scores = stored(scores.withColumn("place", F.row_number().over(best)).where(F.col("place") <= 5 * k))
    kept = _with_documents(scores.join(corpus.chunks.select("id", "owner"), "id"), corpus, now, profiles.filters)
    kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("profile", "owner").orderBy(F.desc("score"), "id"))).where("nth = 1")
    kept = stored(kept.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k))
    discard(scores)
    kept = kept.join(corpus.chunks.select("id", "document"), "id")  # texts only of what is shown
    words = F.array().cast("array<string>")
    if profiles.keywords is not None:
        kept = kept.join(profiles.keywords, "profile", "left")
        words = F.coalesce("keywords", words)
    if profiles.queries is not None:
        kept = kept.join(profiles.queries.select("profile", "query"), "profile", "left")
        words = F.array_union(words, token_set(F.col("query")))
    text = snippet(F.col("document"), config.boost_chars)
    boost = keyword_boost(words, text)
    matched = F.slice(F.array_sort(F.array_intersect(words, tokenize(text))), 1, 10)
    return kept.select(
        "profile", "tender_id", F.col("owner").alias("document_id"), F.col("id").alias("chunk_id"), F.round("score", 4).alias("score"), F.round(boost, 4).alias("keyword_boost"),
        F.round(F.col("score") + boost, 4).alias("final_score"), "pdf_url", "local_path", F.col("doc_source").alias("source"), "title", F.col("ref_no").alias("tender_ref_no"), "duration",
        snippet(F.col("document"), config.snippet_chars).alias("tender_snippet"), F.array_join(matched, "|").alias("matched_keywords"),
    )


def with_reasons(found: DataFrame) -> DataFrame:
    """Results with their snippet and matched keywords as one field ``because``, beside the profile's snippet if it has been added."""
    words = F.filter(F.split("matched_keywords", r"\|"), lambda x: x != "")
    reasons = [F.col(c) for c in ("tender_snippet", "profile_snippet") if c in found.columns]
    return found.withColumn("because", F.struct(*reasons, words.alias("matched_keywords"))).drop("tender_snippet", "profile_snippet", "matched_keywords")


def legacy(corpus: Corpus, profiles: Profiles, now: Column, k: int = 5, config: Config = DEFAULTS) -> DataFrame:
    """The k best chunks of each profile's single vector, mixed with its query's if there is one; several chunks of a document may stay.

    With a query the score is blended with the share of its words in the chunk.
    """
    k = max(1, k)
    asked = profiles.means.select("profile", "vector")
    if profiles.queries is not None:
        asked = asked.join(profiles.queries.select("profile", "query", F.col("vector").alias("query_vector")), "profile", "left")
        asked = asked.select("profile", "query", combined(F.col("vector"), F.col("query_vector")).alias("vector"))
    n = max(50, k) if profiles.queries is not None else k
    found = scored(_near(asked.select(F.col("profile").alias("qid"), "vector"), corpus.chunks, n, corpus.index), 1.0)
    found = found.select(F.col("qid").alias("profile"), "id", F.round("score", 4).alias("score"))
    text = ["document"] if profiles.queries is not None else []
    if text:
        found = found.join(profiles.queries.select("profile", "query"), "profile", "left")
    found = found.join(corpus.chunks.select("id", F.col("owner").alias("own"), F.col("tender_id").alias("chunk_tender"), "chunk_index", *text), "id")
    rerank = F.col("score")
    if text:  # scored at once, so that no text travels on
        words = F.round(overlap_score(F.col("query"), snippet(F.col("document"), config.snippet_chars)) * config.weight_keyword + F.col("score") * config.weight_vector, 4)
        rerank = F.when(F.trim(F.coalesce("query", F.lit(""))) != "", words).otherwise(F.col("score"))
    found = found.withColumn("rerank_score", rerank).drop("query", "document")
    # the document of the chunk's tender, of several the least id; else the chunk's own
    by_tender = corpus.documents.where("tender_id is not null").groupBy(F.col("tender_id").alias("chunk_tender")).agg(F.min("_id").alias("theirs"))
    found = found.join(by_tender, "chunk_tender", "left").withColumn("owner", F.coalesce("theirs", "own"))
    kept = _with_documents(found, corpus, now, profiles.filters)
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("rerank_score"), "id"))).where(F.col("place") <= k)
    return kept.select("profile", F.col("chunk_tender").alias("tender_id"), F.col("own").alias("document_id"), "chunk_index", "score", "rerank_score", F.col("rerank_score").alias("final_score"), "title", F.col("ref_no").alias("tender_ref_no"), "duration", F.col("doc_source").alias("source"), "place")


def profile_snippets(snippets: DataFrame, profile_chunks: DataFrame, owners: DataFrame, n: int = 5) -> DataFrame:
    """For each of ``snippets(profile, qid, vector)`` the best of its n nearest profile chunks that belongs to the profile; empty if none does."""
    found = nearest(snippets.select("qid", "vector"), profile_chunks, n)
    found = found.join(profile_chunks.select("id", F.col("owner").alias("file_hash"), "document"), "id").join(snippets.select("profile", "qid"), "qid").join(owners, ["profile", "file_hash"])
    best = found.groupBy("profile", "qid").agg(F.min_by("document", F.struct("place", "id")).alias("document"))
    return snippets.select("profile", "qid").join(best, ["profile", "qid"], "left").select("profile", "qid", snippet(F.col("document")).alias("profile_snippet"))
