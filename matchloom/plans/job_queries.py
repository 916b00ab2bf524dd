"""Queries of jobs, profiles and caches: which rows are next, what state they are in, and what stands in the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators import state
from matchloom.plans.tables import NOW, current, current_sql, now
from matchloom.session import table
from matchloom.streaming.jobs import document_state, gate, job_state, progress

PENDING_LIMIT = 25


def pending_first(spark: SparkSession, folder: str) -> DataFrame:
    """The next documents to extract, in the order of their ids."""
    return current(spark, folder, "tender_documents", "docling_status", "local_path").where("docling_status = 'pending'").select("_id", "local_path").orderBy("_id").limit(PENDING_LIMIT)


def extraction_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """What a run makes of the pending documents: failed without a file, done if there is an output, else to be extracted."""
    rows = current(spark, folder, "tender_documents", "docling_status", "local_path").where("docling_status = 'pending'")
    known = table(spark, folder, "docling_outputs").select(F.col("document_id").alias("_id"), F.lit(True).alias("known")).distinct()
    status = F.when(F.col("known"), "done").when(F.trim(F.coalesce("local_path", F.lit(""))) == "", "failed").otherwise("extract")
    return rows.join(known, "_id", "left").select("_id", status.alias("outcome"))


def _profile_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder, "company_profiles", "status", "file_hashes").select(F.col("_id").alias("profile_id"), "status", "file_hashes")
    files = rows.select("profile_id", "status", F.explode_outer(F.array_distinct("file_hashes")).alias("file_hash"))
    outputs = current(spark, folder, "company_profile_outputs", "text").select("file_hash", "text", F.lit(True).alias("known"))
    return files.join(outputs, "file_hash", "left")


def job_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each profile that are not done yet, with their state."""
    rows = _profile_files(spark, folder).where(F.col("file_hash").isNotNull())
    return rows.select("profile_id", "file_hash", document_state(F.col("known"), F.col("text")).alias("state")).where("state <> 'done'")


def profile_job_states(spark: SparkSession, folder: str) -> DataFrame:
    """State and progress of each profile's job by its documents."""
    one = document_state(F.col("known"), F.col("text"))
    counted = _profile_files(spark, folder).groupBy("profile_id").agg(
        F.count("file_hash").alias("n_documents"), F.count_if(F.col("file_hash").isNotNull() & (one == "done")).alias("n_done"), F.count_if(F.col("file_hash").isNotNull() & (one == "failed")).alias("n_failed")
    )
    ended = F.col("n_done") + F.col("n_failed")
    return counted.select("*", job_state(F.col("n_done"), F.col("n_failed"), F.col("n_documents")).alias("state"), progress(ended, F.col("n_documents")).alias("progress"))


def status_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the profiles that outputs name may be searched."""
    asked = table(spark, folder, "docling_outputs").where("profile_id is not null").select("profile_id").distinct()
    held = current(spark, folder, "company_profiles", "status").select(F.col("_id").alias("profile_id"), "status", F.lit(True).alias("known"))
    code = F.when(F.trim("profile_id") == "", 400).otherwise(gate(F.col("known"), F.col("status")))
    return asked.join(held, "profile_id", "left").select("profile_id", code.alias("code"))


def merged_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row for the documents that belong together by either key: the values written last, the status of the first."""
    rows = current(spark, folder, "tender_documents", "tender_id", "document_name", "source", "tender_ref_no", "docling_status", "pdf_url", "updated_at", "created_at")
    owners = state.matched_by_either(rows, "_id", ["tender_id", "document_name"], ["source", "tender_ref_no"])
    rows = rows.join(owners, "_id")
    last = F.max_by(F.struct("document_name", "pdf_url", "updated_at"), F.struct("updated_at", "_id"))
    first = F.min_by("docling_status", F.struct("created_at", "_id"))
    return rows.groupBy("owner").agg(last.alias("l"), first.alias("docling_status"), F.count("*").alias("n_rows")).select("owner", "l.document_name", "l.pdf_url", "l.updated_at", "docling_status", "n_rows")


def cache_after_writes(spark: SparkSession, folder: str) -> DataFrame:
    """A cache after new outputs were set, empty ones deleted and old entries swept."""
    cache = table(spark, folder, "company_profile_embeddings").where("indexed_at is not null").groupBy(F.col("file_hash").alias("key")).agg(F.max("indexed_at").alias("cached_at"))
    outputs = current(spark, folder, "company_profile_outputs", "text").where("file_hash is not null")
    full = F.length(F.coalesce("text", F.lit(""))) > 0
    cache = state.cache_set(cache, outputs.where(full).select(F.col("file_hash").alias("key"), now().alias("cached_at")))
    cache = state.cache_delete(cache, outputs.where(~full).select(F.col("file_hash").alias("key")))
    return state.swept(cache, now())[0].select("key", "cached_at")


QUERIES = {f.__name__: f for f in (pending_first, extraction_outcome, job_documents, profile_job_states, status_gate, merged_documents, cache_after_writes)}
_TD, _CP, _CPO = (current_sql(x) for x in ("tender_documents", "company_profiles", "company_profile_outputs"))
_FILES = f"""f AS (SELECT p._id AS profile_id, h AS file_hash FROM {_CP} p LEFT JOIN (SELECT DISTINCT _id, unnest(file_hashes) AS h FROM {_CP}) x ON x._id = p._id),
d AS (SELECT f.profile_id, f.file_hash, CASE WHEN f.file_hash IS NULL THEN NULL WHEN o.file_hash IS NULL THEN 'queued' WHEN length(trim(coalesce(o.text, ''))) = 0 THEN 'failed' ELSE 'done' END AS state FROM f LEFT JOIN {_CPO} o ON o.file_hash = f.file_hash)"""
_REACHED = f"""t AS {_TD},
a AS (SELECT tender_id, document_name, min(_id) AS o FROM t WHERE tender_id IS NOT NULL AND document_name IS NOT NULL GROUP BY 1, 2),
b AS (SELECT source, tender_ref_no, min(_id) AS o FROM t WHERE source IS NOT NULL AND tender_ref_no IS NOT NULL GROUP BY 1, 2),
e AS (SELECT t._id AS x, a.o AS y FROM t JOIN a ON a.tender_id = t.tender_id AND a.document_name = t.document_name UNION SELECT t._id, b.o FROM t JOIN b ON b.source = t.source AND b.tender_ref_no = t.tender_ref_no),
e2 AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reached(id, other) AS (SELECT _id, _id FROM t UNION SELECT r.id, e2.y FROM reached r JOIN e2 ON e2.x = r.other),
owners AS (SELECT id AS _id, min(other) AS owner FROM reached GROUP BY 1)"""
ORACLE = {
    "pending_first": f"SELECT _id, local_path FROM {_TD} WHERE docling_status = 'pending' ORDER BY _id LIMIT {PENDING_LIMIT}",
    "extraction_outcome": f"SELECT _id, CASE WHEN _id IN (SELECT document_id FROM docling_outputs WHERE document_id IS NOT NULL) THEN 'done' WHEN trim(coalesce(local_path, '')) = '' THEN 'failed' ELSE 'extract' END AS outcome FROM {_TD} WHERE docling_status = 'pending'",
    "job_documents": f"WITH {_FILES} SELECT profile_id, file_hash, state FROM d WHERE state IN ('queued', 'failed')",
    "profile_job_states": f"WITH {_FILES}, c AS (SELECT profile_id, count(file_hash) AS n_documents, count(*) FILTER (state = 'done') AS n_done, count(*) FILTER (state = 'failed') AS n_failed FROM d GROUP BY 1) SELECT *, CASE WHEN n_documents = 0 THEN 'done' WHEN n_done + n_failed = 0 THEN 'queued' WHEN n_done + n_failed < n_documents THEN 'running' WHEN n_done = 0 THEN 'failed' ELSE 'done' END AS state, CAST(5 + floor((n_done + n_failed) / greatest(n_documents, 1) * 85) AS INTEGER) AS progress FROM c",
    "status_gate": f"SELECT q.profile_id, CAST(CASE WHEN trim(q.profile_id) = '' THEN 400 WHEN p._id IS NULL THEN 404 WHEN lower(trim(p.status)) = 'ready' THEN 200 ELSE 409 END AS INTEGER) AS code FROM (SELECT DISTINCT profile_id FROM docling_outputs WHERE profile_id IS NOT NULL) q LEFT JOIN {_CP} p ON p._id = q.profile_id",
    "merged_documents": f"WITH RECURSIVE {_REACHED} SELECT owner, l.a AS document_name, l.b AS pdf_url, l.c AS updated_at, f.a AS docling_status, n_rows FROM (SELECT owner, max_by(struct_pack(a := document_name, b := pdf_url, c := updated_at), (updated_at, _id)) AS l, min_by(struct_pack(a := docling_status), (created_at, _id)) AS f, count(*) AS n_rows FROM t JOIN owners USING (_id) GROUP BY owner)",
    "cache_after_writes": f"WITH c AS (SELECT file_hash AS key, max(indexed_at) AS cached_at FROM company_profile_embeddings WHERE indexed_at IS NOT NULL GROUP BY 1), o AS (SELECT file_hash AS key, length(coalesce(text, '')) > 0 AS full_ FROM {_CPO} WHERE file_hash IS NOT NULL) SELECT key, CASE WHEN o.full_ THEN TIMESTAMP '{NOW}' ELSE c.cached_at END AS cached_at FROM c FULL JOIN o USING (key) WHERE coalesce(o.full_, true) AND (o.full_ OR c.cached_at + INTERVAL 168 HOUR > TIMESTAMP '{NOW}')",
}
ORACLE["upsert_documents"] = f"WITH RECURSIVE {_REACHED} SELECT owner, count(*) AS n_rows FROM owners GROUP BY owner"
