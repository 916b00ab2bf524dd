"""Queries of table state: pending rows, joins, upserts, expiry, flags, reuse and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.text import chunk_id, content_hash, parsed_chunk_id
from matchloom.operators import state
from matchloom.operators.documents import index_status
from matchloom.plans.tables import NOW, current, current_sql, now
from matchloom.session import table


def pending_documents(spark: SparkSession, folder: str) -> DataFrame:
    return current(spark, folder, "tender_documents", "docling_status", "local_path").where("docling_status = 'pending'").select("_id", "local_path")


def not_indexed(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder, "docling_outputs", "doc_type", "indexed").where("doc_type = 'tender'")
    return rows.where(state.pending()).select("document_id")


def documents_to_extract(spark: SparkSession, folder: str) -> DataFrame:
    documents = current(spark, folder, "tender_documents", "docling_status")
    done = table(spark, folder, "docling_outputs").select(F.col("document_id").alias("_id")).distinct()
    return documents.where("not (docling_status <=> 'failed')").join(done, "_id", "left_anti").select("_id", "docling_status")


def documents_extracted(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "docling_outputs").select(F.col("document_id").alias("_id")).distinct()
    return current(spark, folder, "tender_documents", "source").join(done, "_id", "left_semi").groupBy("source").agg(F.count("*").alias("n_done"))


def missing_parent_status(spark: SparkSession, folder: str) -> DataFrame:
    outputs = current(spark, folder, "docling_outputs", "doc_type", "text").where("doc_type = 'tender'")
    rows = index_status(outputs, current(spark, folder, "tender_documents", "expires_at"), now())
    return rows.select("document_id", "index_status")


def expiry_filter(spark: SparkSession, folder: str) -> DataFrame:
    return current(spark, folder, "raw_tenders", "expires_at").where(state.live(now())).select("_id")


def cached_status_mark(spark: SparkSession, folder: str) -> DataFrame:
    hashes = current(spark, folder, "company_profiles", "file_hashes").select(F.col("_id").alias("profile_id"), F.explode("file_hashes").alias("file_hash"))
    known = table(spark, folder, "company_profile_embeddings").select("file_hash", F.lit(True).alias("known")).distinct()
    return hashes.join(known, "file_hash", "left").select("profile_id", "file_hash", F.when(F.col("known"), "cached").otherwise("pending").alias("status"))


def reuse_hits(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder, "company_profile_embeddings", "representative_embeddings")
    outputs = current(spark, folder, "company_profile_outputs", "text").select("file_hash")
    held = rows.where(F.size("representative_embeddings") > 0).select("file_hash", F.lit(1).alias("hit"))
    return outputs.join(held, "file_hash", "left").select("file_hash", F.coalesce("hit", F.lit(0)).alias("hit"))


def cache_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """First the cached file, if it is not older than a week, then the stored output."""
    cache = table(spark, folder, "company_profile_embeddings").groupBy(F.col("file_hash").alias("key")).agg(F.max("indexed_at").alias("cached_at"))
    fresh = state.cache_hits(cache, now()).select(F.col("key").alias("file_hash"), F.lit("cache").alias("first"))
    stored = current(spark, folder, "company_profile_outputs", "text").where(F.length("text") > 0).select("file_hash", F.lit("stored").alias("second"))
    return fresh.join(stored, "file_hash", "full").select("file_hash", F.coalesce("first", "second").alias("found_in"))


def upsert_tenders(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_tenders").select("source", "tender_ref_no", "updated_at", "created_at", "expires_at")
    return state.upserted(rows, ["source", "tender_ref_no"], "updated_at", ["created_at", "expires_at"]).withColumn("minted_expiry", state.expiry(F.col("created_at")))


def upsert_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder, "tender_documents", "tender_id", "document_name", "source", "tender_ref_no")
    return state.matched_by_either(rows, "_id", ["tender_id", "document_name"], ["source", "tender_ref_no"]).groupBy("owner").agg(F.count("*").alias("n_rows"))


def reset_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder, "docling_outputs", "doc_type", "indexed", "index_status").where("doc_type = 'tender'")
    rows = rows.withColumns({"indexed": F.lit(False), "index_status": F.lit("rebuild")})
    return rows.groupBy("indexed", "index_status").agg(F.count("*").alias("n_rows"))


def orphan_chunk_replace(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk rows of the first extraction replaced by those of the last: no chunk beyond the new count stays."""
    rows = table(spark, folder, "docling_outputs").where("chunk_count is not null")
    counts = rows.groupBy("document_id").agg(F.min_by("chunk_count", "extracted_at").alias("a"), F.max_by("chunk_count", "extracted_at").alias("b"), F.count("*").alias("n"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)).alias("i")
    old = counts.select("document_id", spread("a"))
    new = counts.where("n > 1").select("document_id", spread("b"))
    return state.replaced(old, new, "document_id").groupBy("document_id").agg(F.count("*").alias("n_chunks"))


def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids minted for every chunk of the outputs, and what reading them gives back."""
    rows = current(spark, folder, "docling_outputs", "doc_type", "chunk_count").where("chunk_count > 0")
    rows = rows.select("document_id", "doc_type", F.explode(F.sequence(F.lit(0), F.col("chunk_count") - 1)).alias("i"))
    rows = rows.withColumn("id", F.concat_ws(":", "doc_type", "document_id", F.col("i").cast("string")))
    return rows.select(F.when(F.col("doc_type") == "tender", chunk_id("tender", F.col("document_id"), F.col("i"))).otherwise(F.col("id")).alias("id"), parsed_chunk_id(F.col("id")).alias("tender_document"))


def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder, "tender_documents", "source", "docling_status")
    return rows.groupBy("source").agg(F.count_if(F.col("docling_status") == "done").alias("n_done"), F.count_if(F.col("docling_status") == "failed").alias("n_failed"), F.count("*").alias("n_all"))


def file_hash_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The files of each company over its profiles, each once, and in the order of first use within a profile."""
    rows = current(spark, folder, "company_profiles", "company_id", "file_hashes").where("company_id is not null and file_hashes is not null")
    ordered = F.array_join(F.array_distinct("file_hashes"), ",")
    every = rows.select("company_id", F.explode("file_hashes").alias("h")).distinct().groupBy("company_id").agg(F.count("*").alias("n_files"), F.min("h").alias("first_file"))
    return rows.select("company_id", "_id", ordered.alias("ordered")).join(every, "company_id")


def document_hashes(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder, "docling_outputs", "text").where("text is not null")
    return rows.select("document_id", content_hash(F.col("text")).alias("content_hash"), content_hash(F.encode("text", "UTF-8")).alias("byte_hash"))


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of 64 chunks within each document."""
    rows = current(spark, folder, "docling_outputs", "chunk_count").where("chunk_count > 0")
    rows = rows.select("document_id", F.explode(F.sequence(F.lit(0), F.col("chunk_count") - 1)).alias("i"))
    return rows.groupBy("document_id", F.floor(F.col("i") / 64).alias("batch")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (pending_documents, not_indexed, documents_to_extract, documents_extracted, missing_parent_status, expiry_filter, cached_status_mark, reuse_hits, cache_lookup, upsert_tenders, upsert_documents, reset_flags, orphan_chunk_replace, chunk_ids, status_counts, file_hash_sets, document_hashes, batches)}
_TD, _OUT, _CP, _CPO, _CPE, _RT = (current_sql(x) for x in ("tender_documents", "docling_outputs", "company_profiles", "company_profile_outputs", "company_profile_embeddings", "raw_tenders"))
ORACLE = {
    "pending_documents": f"SELECT _id, local_path FROM {_TD} WHERE docling_status = 'pending'",
    "not_indexed": f"SELECT document_id FROM {_OUT} WHERE doc_type = 'tender' AND indexed IS DISTINCT FROM true",
    "documents_to_extract": f"SELECT _id, docling_status FROM {_TD} WHERE docling_status IS DISTINCT FROM 'failed' AND _id NOT IN (SELECT document_id FROM docling_outputs WHERE document_id IS NOT NULL)",
    "documents_extracted": f"SELECT source, count(*) AS n_done FROM {_TD} WHERE _id IN (SELECT document_id FROM docling_outputs) GROUP BY source",
    "missing_parent_status": f"SELECT o.document_id, CASE WHEN d._id IS NULL THEN 'tender_document_missing' WHEN d.expires_at <= TIMESTAMP '{NOW}' THEN 'tender_document_expired' WHEN length(trim(coalesce(o.text, ''))) = 0 THEN 'empty' ELSE 'ready' END AS index_status FROM {_OUT} o LEFT JOIN {_TD} d ON d._id = o.document_id WHERE o.doc_type = 'tender'",
    "expiry_filter": f"SELECT _id FROM {_RT} WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}'",
    "cached_status_mark": f"SELECT c.profile_id, c.file_hash, CASE WHEN k.file_hash IS NULL THEN 'pending' ELSE 'cached' END AS status FROM (SELECT _id AS profile_id, unnest(file_hashes) AS file_hash FROM {_CP}) c LEFT JOIN (SELECT DISTINCT file_hash FROM company_profile_embeddings) k USING (file_hash)",
    "reuse_hits": f"SELECT o.file_hash, CASE WHEN len(e.representative_embeddings) > 0 THEN 1 ELSE 0 END AS hit FROM {_CPO} o LEFT JOIN {_CPE} e USING (file_hash)",
    "cache_lookup": f"WITH a AS (SELECT file_hash FROM company_profile_embeddings GROUP BY 1 HAVING max(indexed_at) + INTERVAL 168 HOUR > TIMESTAMP '{NOW}'), b AS (SELECT file_hash FROM {_CPO} WHERE length(text) > 0) SELECT coalesce(a.file_hash, b.file_hash) AS file_hash, CASE WHEN a.file_hash IS NOT NULL THEN 'cache' ELSE 'stored' END AS found_in FROM a FULL JOIN b USING (file_hash)",
    "upsert_tenders": "SELECT source, tender_ref_no, max(updated_at) AS updated_at, min_by(created_at, (updated_at, created_at, expires_at)) AS created_at, min_by(expires_at, (updated_at, created_at, expires_at)) AS expires_at, min_by(created_at, (updated_at, created_at, expires_at)) + INTERVAL 15 DAY AS minted_expiry FROM raw_tenders WHERE source IS NOT NULL AND tender_ref_no IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT source, tender_ref_no, updated_at, created_at, expires_at, created_at + INTERVAL 15 DAY FROM raw_tenders WHERE source IS NULL OR tender_ref_no IS NULL",
    "reset_flags": f"SELECT false AS indexed, 'rebuild' AS index_status, count(*) AS n_rows FROM {_OUT} WHERE doc_type = 'tender'",
    "orphan_chunk_replace": "SELECT document_id, greatest(CASE WHEN count(*) > 1 THEN max_by(chunk_count, extracted_at) ELSE min_by(chunk_count, extracted_at) END, 1)::BIGINT AS n_chunks FROM docling_outputs WHERE chunk_count IS NOT NULL GROUP BY 1",
    "chunk_ids": f"SELECT doc_type || ':' || document_id || ':' || i AS id, CASE WHEN doc_type = 'tender' THEN document_id END AS tender_document FROM (SELECT document_id, doc_type, unnest(range(chunk_count)) AS i FROM {_OUT} WHERE chunk_count > 0)",
    "status_counts": f"SELECT source, count_if(docling_status = 'done')::BIGINT AS n_done, count_if(docling_status = 'failed')::BIGINT AS n_failed, count(*) AS n_all FROM {_TD} GROUP BY source",
    "file_hash_sets": f"WITH r AS (SELECT * FROM {_CP} WHERE company_id IS NOT NULL AND file_hashes IS NOT NULL), e AS (SELECT company_id, count(DISTINCT h) AS n_files, min(h) AS first_file FROM (SELECT company_id, unnest(file_hashes) AS h FROM r) GROUP BY 1) SELECT r.company_id, r._id, array_to_string(list_transform(list_filter(list_transform(range(1, len(file_hashes) + 1), lambda i: {{'i': i, 'h': file_hashes[i]}}), lambda x: list_position(file_hashes, x.h) = x.i), lambda x: x.h), ',') AS ordered, n_files, first_file FROM r JOIN e USING (company_id)",
    "document_hashes": f"SELECT document_id, sha256(text) AS content_hash, sha256(encode(text)) AS byte_hash FROM {_OUT} WHERE text IS NOT NULL",
    "batches": f"SELECT document_id, i // 64 AS batch, count(*) AS n FROM (SELECT document_id, unnest(range(chunk_count)) AS i FROM {_OUT} WHERE chunk_count > 0) GROUP BY 1, 2",
}
