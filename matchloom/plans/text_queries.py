"""Queries of the text, extraction and profile functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.functions import extract, profiles, text
from matchloom.operators.documents import merged, smart_text
from matchloom.plans.tables import NOW, chunks_sql, combined_sql, current, current_sql, now, strip_sql, tokens_sql
from matchloom.session import table

QUESTIONS = ["supply and installation of cables", "annual maintenance of laboratory equipment", "iso 9001 certified software services"]


def tokenize_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


def _chunks(spark: SparkSession, folder: str, most: int, overlap: int) -> DataFrame:
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", F.posexplode(text.chunk_text(F.col("text"), most, overlap)).alias("chunk_index", "chunk"))


def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder, 500, 80)


def chunk_overlap_small(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder, 120, 30)


def chunk_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    rows = _chunks(spark, folder, 500, 80).select((F.floor(F.length("chunk") / 50) * 50).alias("at_least"))
    return rows.groupBy("at_least").agg(F.count("*").alias("n_chunks"))


def title_relevance(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "docling_outputs").select(F.explode("sections").alias("s")).where("s.title is not null").select("s.title")
    return rows.groupBy("title").agg(F.count("*").alias("n")).select("title", "n", text.strip(extract.normal_title(F.col("title"))).alias("normal"), extract.title_is_relevant(F.col("title")).alias("relevant"))


def key_info_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "company_profile_outputs").dropDuplicates(["file_hash"])
    return rows.select("file_hash", *[c.alias(n) for n, c in extract.key_info(F.col("text")).items()])


def extraction_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder, "company_profile_outputs", "text", "relevant_text")
    return rows.select("file_hash", *[c.alias(n) for n, c in extract.extraction_stats(F.col("text"), F.col("relevant_text")).items()])


def relevant_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder, "docling_outputs", "text", "sections", "tables")
    return rows.select("document_id", smart_text(rows).alias("relevant_text"))


def combine_text_tables(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder, "docling_outputs", "text", "tables")
    return rows.select("document_id", extract.combined_text(F.col("text"), F.col("tables")).alias("combined"))


def content_hash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


def keyword_overlap_rank(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "text", F.explode(F.array(*map(F.lit, QUESTIONS))).alias("query"))
    rows = rows.select("query", "doc_id", F.round(text.overlap_score(F.col("query"), F.col("text")), 6).alias("score")).where("score > 0")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("place", best).where("place <= 20")


def link_parts(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder, "tender_documents", "pdf_url", "local_path")
    base = F.lit("https://portal.example/list/index.html")
    return rows.select("_id", text.base_name(F.col("pdf_url")).alias("file_name"), text.resolved(base, F.col("pdf_url")).alias("absolute"), text.resolved(base, F.col("local_path")).alias("from_path"))


def snippets(spark: SparkSession, folder: str) -> DataFrame:
    return current(spark, folder, "docling_outputs", "text").select("document_id", text.snippet(F.col("text")).alias("snippet"))


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    return current(spark, folder, "company_profile_embeddings", "profile_data")


def searchable_text(spark: SparkSession, folder: str) -> DataFrame:
    return _profiles(spark, folder).where("profile_data is not null").select("file_hash", profiles.searchable_text("profile_data").alias("searchable"))


def profile_metadata_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _profiles(spark, folder).where("profile_data is not null").select("file_hash", *[c.alias(n) for n, c in profiles.flags("profile_data").items()]).fillna(-1, ["years_of_experience"])


def profile_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return _profiles(spark, folder).select("file_hash", F.explode(profiles.keywords("profile_data")).alias("keyword"))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    rows = _profiles(spark, folder).where("profile_data is not null")
    outputs = current(spark, folder, "company_profile_outputs", "text")
    return rows.join(outputs, "file_hash")


def keyword_boost(spark: SparkSession, folder: str) -> DataFrame:
    return _asked(spark, folder).select("file_hash", F.round(text.keyword_boost(profiles.keywords("profile_data"), F.col("text")), 6).alias("boost"))


def explain_match(spark: SparkSession, folder: str) -> DataFrame:
    return _asked(spark, folder).select("file_hash", *[c.alias(n) for n, c in profiles.explained("profile_data", F.col("text")).items()])


def _owned(spark: SparkSession, folder: str) -> DataFrame:
    owners = current(spark, folder, "company_profiles", "file_hashes").select(F.col("_id").alias("profile_id"), F.posexplode("file_hashes").alias("pos", "file_hash"))
    outputs = current(spark, folder, "company_profile_outputs", "text", "relevant_text", "tables").withColumn("success", F.length(F.coalesce("text", F.lit(""))) > 0)
    return owners.join(outputs, "file_hash")


def merge_outputs(spark: SparkSession, folder: str) -> DataFrame:
    return merged(_owned(spark, folder), "profile_id")


def filtered_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = current(spark, folder, "tender_documents", "tender_id", "source", "document_type", "expires_at").withColumnRenamed("source", "doc_source")
    tenders = current(spark, folder, "raw_tenders", "title", "source", "duration").select(F.col("_id").alias("tender_id"), "title", "source", "duration")
    wanted = {"source": "works", "title": "OF", "duration": "", "department": "unknown"}
    rows = documents.join(tenders, "tender_id", "left").where(F.col("expires_at").isNull() | (F.col("expires_at") > now()))
    return rows.where(text.filters_pass(wanted, {"source": F.col("doc_source")}, {"title": F.col("title"), "source": F.col("source"), "duration": F.col("duration")})).select("_id", "tender_id")


QUERIES = {f.__name__: f for f in (tokenize_stats, chunk_documents, chunk_overlap_small, chunk_length_histogram, title_relevance, key_info_flags, extraction_stats, relevant_text, combine_text_tables, content_hash_dedup, keyword_overlap_rank, link_parts, snippets, searchable_text, profile_metadata_flags, profile_keywords, keyword_boost, explain_match, merge_outputs, filtered_documents)}


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any(value: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({value}, '{w}')" for w in words) + ")"


_DOCS = "(SELECT doc_id AS key, text AS body FROM documents WHERE text IS NOT NULL)"
_CPE = current_sql("company_profile_embeddings")
_CPO = current_sql("company_profile_outputs")
_OUT = current_sql("docling_outputs")
_P = f"p AS (SELECT file_hash, profile_data.* FROM {_CPE} WHERE profile_data IS NOT NULL)"


def _low(field: str) -> str:
    return f"list_transform(list_filter(coalesce({field}, []), lambda x: x IS NOT NULL), lambda x: lower(x))"


def _held(field: str, words: list[str]) -> str:
    return f"(len(list_filter({_low(field)}, lambda x: {_any('x', words)})) > 0)"


def _joined(field: str, words: list[str]) -> str:
    return _any(f"coalesce(array_to_string({_low(field)}, ' '), '')", words)


_NORMAL = strip_sql("regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g')")
_KEYS = "list_concat(" + ", ".join(_low(x) for x in profiles.KEYWORD_FIELDS) + ")"
_KEYWORDS = f"kw AS (SELECT file_hash, list_distinct(list_filter(list_concat(vals, flatten(list_transform(vals, lambda v: {tokens_sql('v')}))), lambda x: NOT list_contains({_list(profiles.STOP_WORDS)}, x))) AS kw FROM (SELECT file_hash, {_KEYS} AS vals FROM p))"


def _words(field: str) -> str:
    return f"flatten(list_transform({_low(field)}, lambda v: {tokens_sql('v')}))"


_LABELS = ", ".join(
    f"CASE WHEN {f} <> '' THEN '{n}: ' || {f} END" if not j else f"CASE WHEN len({f}) > 0 THEN '{n}: ' || array_to_string(list_filter({f}, lambda x: x IS NOT NULL), '{j}') END" for n, f, j in profiles.LABELS
)
_MATCH = f"WITH {_P}, {_KEYWORDS}, o AS (SELECT file_hash, text FROM {_CPO})"
_RELEVANT_BODIES = f"list_transform(list_filter(coalesce(sections, []), lambda s: s.title IS NOT NULL AND s.title <> '' AND {_any(_NORMAL.replace('title', 's.title'), extract.SECTION_PHRASES)} AND s.text IS NOT NULL AND s.text <> '' AND NOT contains(head, s.text)), lambda s: chr(10) || '### ' || s.title || chr(10) || s.text)"
_RELEVANT_TABLES = f"list_transform(list_filter(coalesce(tables, []), lambda t: t IS NOT NULL AND {_any('lower(t)', extract.TABLE_WORDS)} AND length({strip_sql('t')}) > 20)[1:15], lambda t: chr(10) || '[Table]' || chr(10) || {strip_sql('t')})"

ORACLE = {
    "tokenize_stats": f"SELECT doc_id, len({tokens_sql('text')})::INT AS n_tokens, len(list_distinct({tokens_sql('text')}))::INT AS n_distinct FROM documents",
    "chunk_documents": f"WITH RECURSIVE {chunks_sql(_DOCS, 500, 80)} SELECT key AS doc_id, i::INT AS chunk_index, chunk FROM chunked",
    "chunk_overlap_small": f"WITH RECURSIVE {chunks_sql(_DOCS, 120, 30)} SELECT key AS doc_id, i::INT AS chunk_index, chunk FROM chunked",
    "chunk_length_histogram": f"WITH RECURSIVE {chunks_sql(_DOCS, 500, 80)} SELECT (length(chunk) // 50 * 50)::BIGINT AS at_least, count(*) AS n_chunks FROM chunked GROUP BY 1",
    "title_relevance": f"SELECT title, n, {_NORMAL} AS normal, {_any(_NORMAL, extract.SECTION_PHRASES)} AS relevant FROM (SELECT s.title AS title, count(*) AS n FROM (SELECT unnest(sections) AS s FROM docling_outputs) WHERE s.title IS NOT NULL GROUP BY 1)",
    "key_info_flags": f"SELECT file_hash, {_any('low', extract.ISO_PATTERNS)} AS has_iso_certification, {_any('low', extract.CMMI_PATTERNS)} AS has_cmmi_certification, {_any('low', extract.GOVERNMENT_PATTERNS)} AS has_government_experience, CASE WHEN {_any('low', extract.LARGE_PATTERNS)} THEN 'large' WHEN {_any('low', extract.MEDIUM_PATTERNS)} THEN 'medium' WHEN {_any('low', extract.SMALL_PATTERNS)} THEN 'small' END AS company_size_indicator FROM (SELECT file_hash, lower(coalesce(text, '')) AS low FROM {_CPO})",
    "extraction_stats": f"SELECT file_hash, a AS original_chars, b AS extracted_chars, round(1 - b / greatest(a, 1), 2) AS reduction_ratio, a // 3000 AS original_pages, b // 3000 AS extracted_pages FROM (SELECT file_hash, length(coalesce(text, '')) AS a, length(coalesce(relevant_text, '')) AS b FROM {_CPO})",
    "relevant_text": f"""WITH h AS (SELECT document_id, sections, tables, substr(coalesce(text, ''), 1, 15000) AS head FROM {_OUT}),
parts AS (SELECT document_id, CASE WHEN head <> '' THEN [head] ELSE [] END AS a, {_RELEVANT_BODIES} AS b, {_RELEVANT_TABLES} AS c FROM h),
whole AS (SELECT document_id, coalesce(array_to_string(list_concat(a, b, CASE WHEN len(c) > 0 THEN [chr(10) || chr(10) || '--- Tables ---' || chr(10)] ELSE [] END, c), chr(10) || chr(10)), '') AS w FROM parts),
cut AS (SELECT document_id, w, substr(w, 1, 100000) AS k, length(substr(w, 1, 100000)) - instr(reverse(substr(w, 1, 100000)), '.') + 1 AS p FROM whole)
SELECT document_id, {strip_sql("CASE WHEN length(w) <= 100000 THEN w WHEN contains(k, '.') AND p - 1 > 80000 THEN substr(k, 1, p) ELSE k END")} AS relevant_text FROM cut""",
    "combine_text_tables": f"SELECT document_id, {combined_sql('text', 'tables')} AS combined FROM {_OUT}",
    "content_hash_dedup": "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "keyword_overlap_rank": f"""WITH s AS (SELECT query, doc_id, {tokens_sql('query')} AS q, list_distinct({tokens_sql('text')}) AS t FROM documents, (SELECT unnest({_list(QUESTIONS)}) AS query)),
r AS (SELECT query, doc_id, round(len(list_intersect(list_distinct(q), t)) / len(list_distinct(q)), 6) AS score FROM s)
SELECT query, doc_id, score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS place FROM r WHERE score > 0) WHERE place <= 20""",
    "link_parts": f"SELECT _id, string_split(pdf_url, '/')[-1] AS file_name, CASE WHEN pdf_url ILIKE 'http%' THEN pdf_url WHEN pdf_url LIKE '/%' THEN 'https://portal.example' || pdf_url ELSE 'https://portal.example/list/' || pdf_url END AS absolute, CASE WHEN local_path ILIKE 'http%' THEN local_path WHEN local_path LIKE '/%' THEN 'https://portal.example' || local_path ELSE 'https://portal.example/list/' || local_path END AS from_path FROM {current_sql('tender_documents')}",
    "snippets": f"SELECT document_id, substr(coalesce(text, ''), 1, 350) AS snippet FROM {_OUT}",
    "searchable_text": f"WITH {_P} SELECT file_hash, coalesce(array_to_string(list_filter([{_LABELS}], lambda x: x IS NOT NULL), chr(10)), '') AS searchable FROM p",
    "profile_metadata_flags": f"""WITH {_P} SELECT file_hash, nullif(company_size, '') AS company_size, coalesce(TRY_CAST(regexp_extract(years_of_experience, '^\\s*([+-]?[0-9]+)\\s*$', 1) AS INT), -1) AS years_of_experience,
{_held('certifications', ['iso 9001', 'iso9001'])} AS has_iso_9001, {_held('certifications', ['iso 27001', 'iso27001'])} AS has_iso_27001, {_held('certifications', ['cmmi'])} AS has_cmmi,
{_joined('industries', profiles.IT_WORDS)} AS is_it_company, {_held('industries', ['defense', 'defence'])} AS is_defense, {_held('industries', ['health', 'medical'])} AS is_healthcare,
{_joined('geographic_focus', profiles.PAN_INDIA_WORDS)} AS operates_pan_india, {_joined('geographic_focus', profiles.GLOBAL_WORDS)} AS operates_global FROM p""",
    "profile_keywords": f"WITH {_P}, {_KEYWORDS} SELECT file_hash, unnest(kw) AS keyword FROM kw",
    "keyword_boost": f"{_MATCH} SELECT file_hash, round(CASE WHEN len(kw) > 0 AND len(t) > 0 THEN least(len(list_intersect(kw, t)) / len(kw) * 0.4, 0.2) ELSE 0 END, 6)::DOUBLE AS boost FROM (SELECT file_hash, kw, list_distinct({tokens_sql('text')}) AS t FROM kw JOIN o USING (file_hash))",
    "explain_match": f"""{_MATCH}, m AS (SELECT file_hash, list_sort(list_intersect(kw, list_distinct({tokens_sql('text')}))) AS m FROM kw JOIN o USING (file_hash)),
w AS (SELECT file_hash, {_words('capabilities')} AS c, {_words('key_technologies')} AS t, {_words('domain_expertise')} AS d FROM p)
SELECT file_hash, len(m)::INT AS total_matched, coalesce(array_to_string(list_filter(m, lambda x: list_contains(c, x))[1:5], '|'), '') AS capability_matches,
coalesce(array_to_string(list_filter(m, lambda x: NOT list_contains(c, x) AND list_contains(t, x))[1:5], '|'), '') AS technology_matches,
coalesce(array_to_string(list_filter(m, lambda x: NOT list_contains(c, x) AND NOT list_contains(t, x) AND list_contains(d, x))[1:5], '|'), '') AS domain_matches,
CASE WHEN len(m) > 10 THEN 'strong' WHEN len(m) > 5 THEN 'medium' ELSE 'weak' END AS match_strength FROM m JOIN w USING (file_hash)""",
    "merge_outputs": f"""WITH c AS (SELECT _id AS profile_id, i AS pos, file_hashes[i] AS file_hash FROM (SELECT _id, file_hashes, unnest(range(1, len(file_hashes) + 1)) AS i FROM {current_sql('company_profiles')})),
j AS (SELECT profile_id, pos, file_hash, length(coalesce(text, '')) > 0 AS good, coalesce(text, '') AS text, CASE WHEN relevant_text <> '' THEN relevant_text ELSE coalesce(text, '') END AS t, tables FROM c JOIN {_CPO} USING (file_hash))
SELECT profile_id, count_if(good) > 0 AS success, count_if(good)::BIGINT AS document_count, coalesce(string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) FILTER (good AND t <> ''), '') AS text,
coalesce(string_agg(file_hash, ',' ORDER BY pos) FILTER (good), '') AS file_hashes, coalesce(sum(len(tables)) FILTER (good), 0)::BIGINT AS n_tables, coalesce(sum(length(text)) FILTER (good), 0)::BIGINT AS original_chars, coalesce(sum(length(t)) FILTER (good), 0)::BIGINT AS extracted_chars,
round(1 - coalesce(sum(length(t)) FILTER (good), 0) / greatest(coalesce(sum(length(text)) FILTER (good), 0), 1), 2) AS reduction_ratio FROM j GROUP BY profile_id""",
    "filtered_documents": f"""SELECT d._id, d.tender_id FROM {current_sql('tender_documents')} d LEFT JOIN {current_sql('raw_tenders')} r ON r._id = d.tender_id
WHERE (d.expires_at IS NULL OR d.expires_at > TIMESTAMP '{NOW}') AND (coalesce(d.source, r.source) IS NULL OR contains(lower(coalesce(d.source, r.source)), 'works')) AND (r.title IS NULL OR contains(lower(r.title), 'of'))""",
}

