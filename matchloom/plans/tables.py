"""The tables of a data folder with each key once, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.vectors import usable
from matchloom.operators.documents import embedded_chunks, profile_chunks, tender_chunks
from matchloom.operators.state import latest
from matchloom.session import stored, table

#: The time at which expiry is judged, so that results do not depend on the clock.
NOW = "2024-10-01 00:00:00"
KEYS = {
    "raw_tenders": ("_id", "updated_at"), "tender_documents": ("_id", "updated_at"), "docling_outputs": ("document_id", "extracted_at"),
    "company_profiles": ("_id", "updated_at"), "company_profile_outputs": ("file_hash", "updated_at"), "company_profile_embeddings": ("file_hash", "updated_at"),
}
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def current(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The latest row of each key, with the columns asked for."""
    key, by = KEYS[name]
    rows = table(spark, folder, name)
    if columns:
        rows = rows.select(*dict.fromkeys([key, by, *columns]))
    kept = latest(rows, [key], by)
    return kept.select(*dict.fromkeys([key, *columns])) if columns else kept


def current_sql(name: str) -> str:
    """The same rows in SQL."""
    key, by = KEYS[name]
    return f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {by} DESC NULLS LAST) AS rn FROM {name}) WHERE rn = 1)"


def profile_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``(profile, nth, vector)``: the usable representative vectors of each file."""
    rows = current(spark, folder, "company_profile_embeddings", "representative_embeddings")
    rows = rows.select(F.col("file_hash").alias("profile"), F.posexplode("representative_embeddings").alias("nth", "vector"))
    return rows.where(usable(F.col("vector"), 64))


def profile_means(spark: SparkSession, folder: str) -> DataFrame:
    """``(profile, vector)``: the usable summary vector of each file."""
    rows = current(spark, folder, "company_profile_embeddings", "summary_embedding")
    return rows.select(F.col("file_hash").alias("profile"), F.col("summary_embedding").alias("vector")).where(usable(F.col("vector"), 64))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the tender outputs that may be searched."""
    outputs = current(spark, folder, "docling_outputs", "doc_type", "tender_id", "text", "tables")
    return tender_chunks(outputs, current(spark, folder, "tender_documents", "expires_at"), now())


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Those chunks with their vectors, written once."""
    return stored(embedded_chunks(chunks(spark, folder)))


def own_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the profile outputs."""
    return profile_chunks(current(spark, folder, "company_profile_outputs", "text", "relevant_text", "tables"))


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def tokens_sql(text: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9]+'), lambda x: lower(x))"


def usable_sql(v: str) -> str:
    return f"({v} IS NOT NULL AND len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0)"


def combined_sql(text: str, tables: str) -> str:
    parts = f"list_concat([coalesce({text}, '')], list_transform(coalesce({tables}, []), lambda x: {strip_sql('coalesce(x, ' + chr(39) * 2 + ')')}))"
    return strip_sql(f"array_to_string(list_filter({parts}, lambda x: x <> ''), chr(10))")


def chunks_sql(source: str, most: int, overlap: int, name: str = "chunked") -> str:
    """CTEs ``<name>(key, i, chunk)`` over a subquery ``source(key, body)``; needs WITH RECURSIVE."""
    sp = SPACE
    return f"""
{name}_lines AS (SELECT key, list_filter(list_transform(string_split(regexp_replace(body, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS lines FROM {source}),
{name}_parts AS (SELECT key, flatten(list_transform(lines, lambda p: CASE WHEN length(p) <= {most} THEN [p] ELSE
  flatten(list_transform(string_split(regexp_replace(p, '([.!?]){sp}+', '\\1' || chr(30), 'g'), chr(30)), lambda s: list_transform(range(0, greatest(1, CAST(ceil(length(s) / {most}.0) AS BIGINT))), lambda k: substr(s, CAST(k * {most} + 1 AS BIGINT), {most})))) END)) AS parts FROM {name}_lines),
{name}_pieces AS (SELECT key, list_filter(list_transform(parts, lambda x: {strip_sql('x')}), lambda x: x <> '') AS pieces FROM {name}_parts),
{name}_fold AS (
  SELECT key, pieces, 1 AS i, pieces[1] AS cur, CAST(NULL AS VARCHAR) AS done FROM {name}_pieces WHERE len(pieces) > 0
  UNION ALL
  SELECT key, pieces, i + 1,
    CASE WHEN i + 1 > len(pieces) THEN NULL WHEN length(cur) + 1 + length(pieces[i + 1]) <= {most} THEN cur || ' ' || pieces[i + 1]
      ELSE trim(trim(CASE WHEN contains(right(cur, {overlap}), ' ') THEN substr(right(cur, {overlap}), instr(right(cur, {overlap}), ' ') + 1) ELSE right(cur, {overlap}) END) || ' ' || pieces[i + 1]) END,
    CASE WHEN i + 1 > len(pieces) OR length(cur) + 1 + length(pieces[i + 1]) > {most} THEN cur END
  FROM {name}_fold WHERE i <= len(pieces)),
{name} AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS i, done AS chunk FROM {name}_fold WHERE done IS NOT NULL)"""


def tender_chunks_sql() -> str:
    """CTEs ``chunks(id, owner, tender_id, chunk_index, document)``."""
    body = f"(SELECT o.document_id AS key, o.tender_id, {combined_sql('o.text', 'o.tables')} AS body FROM {current_sql('docling_outputs')} o JOIN {current_sql('tender_documents')} d ON d._id = o.document_id WHERE o.doc_type = 'tender' AND (d.expires_at IS NULL OR d.expires_at > TIMESTAMP '{NOW}') AND length(trim(coalesce(o.text, ''))) > 0)"
    return f"bodies AS {body}," + chunks_sql("bodies", 500, 80) + ",\nchunks AS (SELECT 'tender:' || c.key || ':' || i AS id, c.key AS owner, b.tender_id, i AS chunk_index, chunk AS document FROM chunked c JOIN bodies b ON b.key = c.key)"


def vectors_sql(source: str = "chunks", name: str = "vectors") -> str:
    """CTEs ``<name>(id, v)`` of the token-hashing embedder over ``source(id, document)``."""
    return f"""
{name}_tok AS (SELECT id, unnest({tokens_sql('document')}) AS tok FROM {source}),
{name}_dim AS (SELECT id, CAST(('0x' || substr(md5(tok), 1, 8)) AS UBIGINT) % 64 AS d, sum(CASE WHEN CAST(('0x' || substr(md5(tok), 9, 2)) AS UBIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS n FROM {name}_tok GROUP BY 1, 2),
{name}_map AS (SELECT id, map_from_entries(list((d, n))) AS m, sqrt(CAST(sum(n * n) AS DOUBLE)) AS size FROM {name}_dim GROUP BY id),
{name} AS (SELECT s.id, CASE WHEN m.m IS NULL THEN list_transform(range(64), lambda x: 0.0::DOUBLE) ELSE list_transform(range(64), lambda x: CASE WHEN m.size > 0 THEN CAST(coalesce(m.m[CAST(x AS UBIGINT)], 0) AS DOUBLE) / m.size ELSE 0.0::DOUBLE END) END AS v FROM {source} s LEFT JOIN {name}_map m ON m.id = s.id)"""


REPS_SQL = f"reps AS (SELECT profile, nth, CAST(v AS DOUBLE[]) AS v FROM (SELECT file_hash AS profile, i - 1 AS nth, representative_embeddings[i] AS v FROM (SELECT file_hash, representative_embeddings, unnest(range(1, len(representative_embeddings) + 1)) AS i FROM {current_sql('company_profile_embeddings')})) WHERE {usable_sql('v')})"
MEANS_SQL = f"means AS (SELECT file_hash AS profile, CAST(summary_embedding AS DOUBLE[]) AS v FROM {current_sql('company_profile_embeddings')} WHERE {usable_sql('summary_embedding')})"


def distance_sql(a: str, b: str) -> str:
    """Cosine distance rounded to nine digits; 1 for a zero vector."""
    return f"(round(CASE WHEN list_dot_product({a}, {a}) > 0 AND list_dot_product({b}, {b}) > 0 THEN 1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) ELSE 1.0 END, 9) + 0.0)"
