"""From extracted documents to chunk vectors, and merged outputs of a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.config import DEFAULTS, Config
from matchloom.functions.extract import combined_text, relevant_text
from matchloom.functions.text import chunk_id, chunk_text
from matchloom.operators.embed import HashingEmbedder, embedded
from matchloom.operators.state import live


def index_status(outputs: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """Each tender output with the reason why it is not indexed: no parent row, or an expired one; ``ready`` else."""
    parents = documents.select(F.col("_id").alias("document_id"), "expires_at", F.lit(True).alias("_found"))
    joined = outputs.join(parents, "document_id", "left")
    status = F.when(F.col("_found").isNull(), "tender_document_missing").when(~live(now), "tender_document_expired").when(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0, "empty").otherwise("ready")
    return joined.withColumn("index_status", status).drop("_found")


def chunk_table(rows: DataFrame, kind: str, owner: str, text: Column, most: int, overlap: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, owner, chunk_index, document)`` of the chunks of each row's text, with the columns to ``keep``."""
    chunks = rows.select(F.col(owner).alias("owner"), *keep, F.posexplode(chunk_text(text, most, overlap)).alias("chunk_index", "document"))
    return chunks.select(chunk_id(kind, F.col("owner"), F.col("chunk_index")).alias("id"), "owner", *keep, "chunk_index", "document")


def embedded_chunks(chunks: DataFrame, make: type = HashingEmbedder) -> DataFrame:
    """Chunks with their vectors."""
    return chunks.withColumn("vector", embedded(F.col("document"), make))


def tender_chunks(outputs: DataFrame, documents: DataFrame, now: Column, config: Config = DEFAULTS) -> DataFrame:
    """Chunks of the tender outputs that are ready to be indexed: text and tables, 500 characters, 80 of overlap."""
    ready = index_status(outputs.where("doc_type = 'tender'"), documents, now).where("index_status = 'ready'")
    return chunk_table(ready, "tender", "document_id", combined_text(F.col("text"), F.col("tables")), config.tender_chunk, config.tender_overlap, ("tender_id",))


def profile_chunks(outputs: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Chunks of profile outputs: the relevant text if there is any, else text and tables; 800 characters, 100 of overlap."""
    text = F.coalesce(F.when(F.col("relevant_text") != "", F.col("relevant_text")), combined_text(F.col("text"), F.col("tables")))
    return chunk_table(outputs, "profile", "file_hash", text, config.profile_chunk, config.profile_overlap)


def smart_text(rows: DataFrame) -> Column:
    """Relevant text of a row with text, sections and tables."""
    return relevant_text(F.col("text"), F.col("sections"), F.col("tables"))


def merged(outputs: DataFrame, key: str) -> DataFrame:
    """The outputs ``(key, pos, success, text, relevant_text, tables, file_hash)`` of each key as one document.

    Only successful outputs count; texts stand in the order of ``pos``. A key without any has success false.
    """
    good = F.col("success")
    text = F.coalesce(F.when(F.col("relevant_text") != "", F.col("relevant_text")), F.col("text"), F.lit(""))
    ordered = lambda value: F.transform(F.array_sort(F.collect_list(F.when(good, F.struct("pos", value.alias("v"))))), lambda x: x["v"])
    original = F.coalesce(F.sum(F.when(good, F.length(F.coalesce("text", F.lit(""))))), F.lit(0))
    extracted = F.coalesce(F.sum(F.when(good, F.length(text))), F.lit(0))
    return outputs.groupBy(key).agg(
        (F.count_if(good) > 0).alias("success"),
        F.count_if(good).alias("document_count"),
        F.array_join(F.filter(ordered(text), lambda x: x != ""), "\n\n---\n\n").alias("text"),
        F.array_join(F.filter(ordered(F.coalesce("file_hash", F.lit(""))), lambda x: x != ""), ",").alias("file_hashes"),
        F.coalesce(F.sum(F.when(good, F.size(F.coalesce("tables", F.array().cast("array<string>"))))), F.lit(0)).alias("n_tables"),
        original.alias("original_chars"),
        extracted.alias("extracted_chars"),
        F.round(1 - extracted / F.greatest(original, F.lit(1)), 2).alias("reduction_ratio"),
    )
