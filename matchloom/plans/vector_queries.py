"""Queries of vectors, pools, clusters and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.functions import profiles, vectors as algebra
from matchloom.operators import cluster, search
from matchloom.operators.approximate import approximately_nearest, inverted
from matchloom.operators.documents import embedded_chunks
from matchloom.operators.embed import embedded
from matchloom.operators.vectors import fused, multi_vector_similarity, nearest, pooled, scored
from matchloom.plans import tables
from matchloom.plans.tables import MEANS_SQL, NOW, REPS_SQL, chunks_sql, combined_sql, current, current_sql, distance_sql, tender_chunks_sql, tokens_sql, vectors_sql
from matchloom.session import discard, materialise, stored, table

K = 5
FIELD_FILTERS = {"tender_ref_no": "20", "document_type": "no"}
QUESTION = "annual maintenance of laboratory equipment and cables"


def _base(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("id"), "label", F.col("embedding").alias("vector"))


def _long(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.posexplode("vector").alias("dim", "x")).select(*keys, "dim", F.round("x", 6).alias("x"))


def vector_norms(spark: SparkSession, folder: str) -> DataFrame:
    return _base(spark, folder).select("id", F.round(algebra.norm(F.col("vector")), 6).alias("norm"))


def normalised_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _long(tables.profile_means(spark, folder).select("profile", algebra.normalised(F.col("vector")).alias("vector")), "profile")


def label_mean_vector(spark: SparkSession, folder: str) -> DataFrame:
    return _long(pooled(_base(spark, folder), ["label"]), "label")


def label_max_vector(spark: SparkSession, folder: str) -> DataFrame:
    return _long(pooled(_base(spark, folder), ["label"], how="max"), "label")


def _profile_means(spark: SparkSession, folder: str) -> DataFrame:
    files = current(spark, folder, "company_profiles", "file_hashes").select(F.col("_id").alias("profile_id"), F.explode("file_hashes").alias("profile")).distinct()
    return pooled(files.join(tables.profile_means(spark, folder), "profile"), ["profile_id"])


def mean_of_means(spark: SparkSession, folder: str) -> DataFrame:
    return _long(_profile_means(spark, folder), "profile_id")


def profile_representatives(spark: SparkSession, folder: str) -> DataFrame:
    """All representatives of a profile over its files, in the order of the files."""
    files = current(spark, folder, "company_profiles", "file_hashes").select(F.col("_id").alias("profile_id"), F.posexplode("file_hashes").alias("pos", "profile"))
    rows = files.join(tables.profile_vectors(spark, folder), "profile")
    place = F.row_number().over(Window.partitionBy("profile_id").orderBy("pos", "nth"))
    return rows.select("profile_id", (place - 1).alias("place"), "profile", "nth")


def first_profile_data(spark: SparkSession, folder: str) -> DataFrame:
    """The first file of each profile that has structured data, and the first up to it that has representatives."""
    files = current(spark, folder, "company_profiles", "file_hashes").select(F.col("_id").alias("profile_id"), F.posexplode("file_hashes").alias("pos", "file_hash"))
    rows = files.join(current(spark, folder, "company_profile_embeddings", "profile_data", "representative_embeddings"), "file_hash")
    data = rows.where("profile_data is not null").groupBy("profile_id").agg(F.min("pos").alias("stop"), F.min_by("file_hash", "pos").alias("data_file"))
    rows = rows.join(data, "profile_id", "left").where((F.size("representative_embeddings") > 0) & (F.col("stop").isNull() | (F.col("pos") <= F.col("stop"))))
    first = rows.groupBy("profile_id").agg(F.min_by("file_hash", "pos").alias("vector_file"))
    return data.select("profile_id", "data_file").join(first, "profile_id", "full")


def representatives_given_labels(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.representatives_of_labels(_base(spark, folder)).select("label", "id", F.round("distance", 6).alias("distance"))


def kmeans_representatives(spark: SparkSession, folder: str) -> DataFrame:
    chunks = embedded_chunks(tables.own_chunks(spark, folder)).select("owner", "chunk_index", "vector")
    return cluster.representatives(chunks)


def knn_top5(spark: SparkSession, folder: str) -> DataFrame:
    rows = _base(spark, folder)
    found = nearest(rows.select(F.col("id").alias("qid"), "vector"), rows.select("id", "vector"), K)
    return found.select("qid", "id", F.round("distance", 6).alias("distance"), "place")


def knn_per_representative(spark: SparkSession, folder: str) -> DataFrame:
    asked = tables.profile_vectors(spark, folder).select(F.concat_ws("|", "profile", "nth").alias("qid"), "vector")
    found = nearest(asked, _base(spark, folder).select("id", "vector"), K)
    return found.select("qid", "id", F.round("distance", 6).alias("distance"), "place")


def _similarities(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of every representative to the mean of every label (ten labels)."""
    labels = pooled(_base(spark, folder), ["label"])
    found = nearest(tables.profile_vectors(spark, folder).select(F.concat_ws("|", "profile", "nth").alias("qid"), "vector"), labels.select(F.col("label").alias("id"), "vector"), 1_000)
    return found.select(F.substring_index("qid", "|", 1).alias("profile"), F.col("id").alias("label"), (1 - F.col("distance")).alias("similarity"))


def _multi(how: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return multi_vector_similarity(_similarities(spark, folder), ["profile", "label"], how).withColumn("similarity", F.round("similarity", 6))

    return run


def embed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors of all chunks, summed by dimension and sign."""
    rows = tables.vectors(spark, folder).select("id", F.posexplode("vector").alias("dim", "x"))
    return rows.groupBy("dim").agg(F.count_if(F.col("x") > 0).alias("positive"), F.count_if(F.col("x") < 0).alias("negative"), F.round(F.max("x"), 6).alias("highest"))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    asked = current(spark, folder, "company_profile_embeddings", "updated_at").select(F.col("file_hash").alias("profile"), F.lit(QUESTION).alias("query"))
    return materialise(asked.withColumn("vector", embedded(F.col("query"))))


def _single(weight: float, asked):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = search.single_vector_scores(asked(spark, folder), tables.vectors(spark, folder), K, weight)
        return found.select("profile", "id", F.round("score", 6).alias("score"))

    return run


mean_search_weighted = _single(0.8, tables.profile_means)


def query_search_weighted(spark: SparkSession, folder: str) -> DataFrame:
    asked = spark.createDataFrame([("q", QUESTION)], "profile string, query string").withColumn("vector", embedded(F.col("query")))
    return search.single_vector_scores(asked, tables.vectors(spark, folder), 50, 0.9).select("profile", "id", F.round("score", 6).alias("score"))


def combined_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = _questions(spark, folder).withColumnRenamed("vector", "qv").join(tables.profile_means(spark, folder), "profile")
    return _long(rows.select("profile", algebra.combined(F.col("vector"), F.col("qv")).alias("vector")), "profile")


def fuse_max(spark: SparkSession, folder: str) -> DataFrame:
    base = _base(spark, folder).select("id", "vector")
    means = scored(nearest(tables.profile_means(spark, folder).select(F.col("profile").alias("qid"), "vector"), base, K), 0.8).select(F.col("qid").alias("profile"), "id", "score")
    many = search.multi_vector_scores(tables.profile_vectors(spark, folder), base, K)
    return fused(means, many, keys=["profile", "id"]).withColumn("score", F.round("score", 6))


def _corpus(spark: SparkSession, folder: str) -> search.Corpus:
    return search.Corpus(tables.vectors(spark, folder), current(spark, folder, "tender_documents"), current(spark, folder, "raw_tenders"))


def _keywords(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder, "company_profile_embeddings", "profile_data")
    return rows.select(F.col("file_hash").alias("profile"), profiles.keywords("profile_data").alias("keywords"))


def _asking(spark: SparkSession, folder: str, query: bool = False, filters: dict | None = None) -> search.Profiles:
    return search.Profiles(tables.profile_vectors(spark, folder), tables.profile_means(spark, folder), _keywords(spark, folder), _questions(spark, folder) if query else None, filters or {})


_SHOWN = ["profile", "tender_id", "document_id", "chunk_id", "score", "keyword_boost", "final_score", "source", "title", "matched_keywords"]


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.hybrid(_corpus(spark, folder), _asking(spark, folder), tables.now(), K).select(_SHOWN)


def hybrid_search_with_query(spark: SparkSession, folder: str) -> DataFrame:
    return search.hybrid(_corpus(spark, folder), _asking(spark, folder, True), tables.now(), K).select(_SHOWN)


def filtered_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.hybrid(_corpus(spark, folder), _asking(spark, folder, filters={"source": "WORKS", "location": "anywhere", "title": ""}), tables.now(), K).select(_SHOWN)


def filtered_search_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Filters on fields of both tables: a reference, which both have, and a type, which only documents have."""
    return search.hybrid(_corpus(spark, folder), _asking(spark, folder, filters=FIELD_FILTERS), tables.now(), K).select(_SHOWN)


def search_results(spark: SparkSession, folder: str) -> DataFrame:
    """The five best of each profile with the reasons for them."""
    return search.with_reasons(search.hybrid(_corpus(spark, folder), _asking(spark, folder), tables.now(), K)).select("profile", "document_id", "final_score", F.col("because.tender_snippet").alias("tender_snippet"), F.array_join("because.matched_keywords", "|").alias("matched_keywords"))


def multi_vector_similarity_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of each profile to the labels by its representatives, or by its mean vector if it has none."""
    labels = materialise(pooled(_base(spark, folder), ["label"]).select(F.col("label").alias("id"), "vector"))
    means = nearest(tables.profile_means(spark, folder).select(F.col("profile").alias("qid"), "vector"), labels, 1_000)
    means = means.select(F.col("qid").alias("profile"), F.col("id").alias("label"), (1 - F.col("distance")).alias("similarity"))
    return multi_vector_similarity(_similarities(spark, folder), ["profile", "label"], "max", means).withColumn("similarity", F.round("similarity", 6))


def approximate_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the inverted file reaches its recall: for a query set of every fiftieth vector against all, by brute force."""
    base = materialise(_base(spark, folder).select("id", "vector"))
    asked = base.where(F.col("id").cast("long") % 50 == 0).withColumnRenamed("id", "qid")
    found = approximately_nearest(asked, inverted(base, K, 0.97), K).select("qid", "id", F.lit(1).alias("hit"))
    met = nearest(asked, base, K).select("qid", "id").join(found, ["qid", "id"], "left")
    return met.agg(F.countDistinct("qid").alias("n_queries"), (F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)) >= 0.95).alias("reached"))


def legacy_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.legacy(_corpus(spark, folder), _asking(spark, folder), tables.now(), K).drop("place")


def legacy_search_with_query(spark: SparkSession, folder: str) -> DataFrame:
    return search.legacy(_corpus(spark, folder), _asking(spark, folder, True), tables.now(), K).drop("place")


def profile_snippet(spark: SparkSession, folder: str) -> DataFrame:
    """For each profile's best hit the snippet of its own chunks that explains it."""
    corpus = _corpus(spark, folder)
    hits = search.hybrid(corpus, _asking(spark, folder), tables.now(), 1)
    asked = materialise(hits.select("profile", F.concat_ws("|", "profile", "chunk_id").alias("qid"), embedded(F.col("tender_snippet")).alias("vector")))
    discard(corpus.chunks)  # the profiles' own chunks are searched next
    own = stored(embedded_chunks(tables.own_chunks(spark, folder)))
    owners = tables.profile_means(spark, folder).select("profile", F.col("profile").alias("file_hash"))
    return search.profile_snippets(asked, own, owners).select("profile", "profile_snippet")


QUERIES = {f.__name__: f for f in (vector_norms, normalised_vectors, label_mean_vector, label_max_vector, mean_of_means, profile_representatives, first_profile_data, representatives_given_labels, kmeans_representatives, knn_top5, knn_per_representative, embed_chunks, query_search_weighted, combined_vectors, fuse_max, hybrid_search, hybrid_search_with_query, filtered_search, filtered_search_fields, search_results, approximate_recall, multi_vector_similarity_fallback, legacy_search, legacy_search_with_query, profile_snippet)}
QUERIES |= {"mean_search_weighted": mean_search_weighted} | {f"multi_vector_similarity_{how}": _multi(how) for how in ("max", "mean", "weighted")}

_BASE = "base AS (SELECT lpad(CAST(vec_id AS VARCHAR), 12, '0') AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_UNIT = "CASE WHEN sum(x * x) OVER (PARTITION BY {k}) > 0 THEN x / sqrt(sum(x * x) OVER (PARTITION BY {k})) ELSE x END"


def _pool(source: str, key: str, how: str) -> str:
    return f"(SELECT {key}, d, {_UNIT.format(k=key)} AS x FROM (SELECT {key}, d, {how}(x) AS x FROM (SELECT {key}, unnest(v) AS x, unnest(range(len(v))) AS d FROM {source}) GROUP BY 1, 2))"


_CP = current_sql("company_profiles")
_CPE = current_sql("company_profile_embeddings")
_FILES = f"files AS (SELECT _id AS profile_id, i - 1 AS pos, file_hashes[i] AS profile FROM (SELECT _id, file_hashes, unnest(range(1, len(file_hashes) + 1)) AS i FROM {_CP}))"


def _near(asked: str, corpus: str, n: int) -> str:
    """(qid, id, distance, place) of asked(qid, v) against corpus(id, v)."""
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS place FROM (SELECT a.qid, c.id, {distance_sql('a.v', 'c.v')} AS distance FROM {asked} a, {corpus} c)) WHERE place <= {n})"


_LABELS = f"labels AS (SELECT CAST(label AS VARCHAR) AS id, list(x ORDER BY d) AS v FROM {_pool('base', 'label', 'avg')} GROUP BY label)"
_SIM = f"WITH {_BASE}, {_LABELS}, {REPS_SQL}, sim AS (SELECT r.profile, l.id AS label, 1 - {distance_sql('r.v', 'l.v')} AS s FROM reps r, labels l)"
_VEC = f"{tender_chunks_sql()}, {vectors_sql()}"
_QVEC = f"qtext AS (SELECT 'q' AS id, '{QUESTION}' AS document), {vectors_sql('qtext', 'qvec')}"


def _score(found: str, weight: float, profile: str = "qid") -> str:
    return f"SELECT {profile} AS profile, id, round(greatest(0, 1 - distance) * {weight}, 9) AS score FROM {found}"


def _hybrid(query: bool, where: str = "true", k: int = K) -> str:
    asked = f"UNION ALL {_score('nq', 0.9)}" if query else ""
    nq = f", questions AS (SELECT e.file_hash AS qid, qvec.v FROM {_CPE} e, qvec), nq AS {_near('questions', 'vectors', 2 * k)}" if query else ""
    words = f"list_distinct(list_concat(coalesce(kw.kw, []), {tokens_sql(chr(39) + QUESTION + chr(39))}))" if query else "coalesce(kw.kw, [])"
    keys = "list_concat(" + ", ".join(f"list_transform(list_filter(coalesce({x}, []), lambda x: x IS NOT NULL), lambda x: lower(x))" for x in profiles.KEYWORD_FIELDS) + ")"
    stop = "[" + ", ".join(f"'{w}'" for w in profiles.STOP_WORDS) + "]"
    return f"""WITH RECURSIVE {_VEC}, {REPS_SQL}, {MEANS_SQL}{', ' + _QVEC if query else ''},
areps AS (SELECT profile || '|' || nth AS qid, v FROM reps), ameans AS (SELECT profile AS qid, v FROM means),
n1 AS {_near('areps', 'vectors', 6 * k)}, n2 AS {_near('ameans', 'vectors', 2 * k)}{nq},
fused AS (SELECT profile, id, max(score) AS score FROM ({_score('n1', 1.0, "split_part(qid, '|', 1)")} UNION ALL {_score('n2', 0.8)} {asked}) GROUP BY 1, 2),
cut AS (SELECT f.*, c.owner, c.document FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, id) AS p FROM fused) f JOIN chunks c USING (id) WHERE p <= {5 * k}),
joined AS (SELECT cut.*, d.tender_id, d.source, r.title, d.document_type FROM cut JOIN {current_sql('tender_documents')} d ON d._id = cut.owner LEFT JOIN {current_sql('raw_tenders')} r ON r._id = d.tender_id
  WHERE (d.expires_at IS NULL OR d.expires_at > TIMESTAMP '{NOW}') AND {where}),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile, owner ORDER BY score DESC, id) AS nth FROM joined) WHERE nth = 1),
best AS (SELECT * FROM (SELECT * EXCLUDE (p), row_number() OVER (PARTITION BY profile ORDER BY score DESC, id) AS p FROM one) WHERE p <= {k}),
kw AS (SELECT file_hash AS profile, list_distinct(list_filter(list_concat(vals, flatten(list_transform(vals, lambda v: {tokens_sql('v')}))), lambda x: NOT list_contains({stop}, x))) AS kw FROM (SELECT file_hash, {keys} AS vals FROM (SELECT file_hash, profile_data.* FROM {_CPE} WHERE profile_data IS NOT NULL))),
w AS (SELECT best.*, {words} AS words, list_distinct({tokens_sql('substr(document, 1, 500)')}) AS toks FROM best LEFT JOIN kw USING (profile)),
b AS (SELECT *, CASE WHEN len(words) > 0 AND len(toks) > 0 THEN least(len(list_intersect(words, toks)) / len(words) * 0.4, 0.2) ELSE 0.0 END AS boost FROM w)
SELECT profile, tender_id, owner AS document_id, id AS chunk_id, round(score, 4) AS score, round(boost, 4)::DOUBLE AS keyword_boost, round(score + boost, 4)::DOUBLE AS final_score, source, title, coalesce(array_to_string(list_sort(list_intersect(words, toks))[1:10], '|'), '') AS matched_keywords FROM b"""


def _legacy(query: bool) -> str:
    asked = f"asked AS (SELECT profile AS qid, list_transform(m, lambda x: CASE WHEN list_dot_product(m, m) > 0 THEN x / sqrt(list_dot_product(m, m)) ELSE x END) AS v FROM (SELECT profile, list_transform(list_zip(means.v, qvec.v), lambda x: (x[1] + x[2]) / 2) AS m FROM means, qvec))" if query else "asked AS (SELECT profile AS qid, v FROM means)"
    q = f"list_distinct({tokens_sql(chr(39) + QUESTION + chr(39))})"
    rerank = f"round(score * 0.7 + len(list_intersect({q}, {tokens_sql('tender_snippet')})) / len({q}) * 0.3, 4)" if query else "score"
    return f"""WITH RECURSIVE {_VEC}, {MEANS_SQL}{', ' + _QVEC if query else ''}, {asked},
f AS (SELECT qid AS profile, n.id, round(round(greatest(0, 1 - distance), 9), 4) AS score, c.owner AS own, c.tender_id, c.chunk_index, substr(c.document, 1, 350) AS tender_snippet FROM {_near('asked', 'vectors', 50 if query else K)} n JOIN chunks c USING (id)),
t AS (SELECT tender_id, min(_id) AS theirs FROM {current_sql('tender_documents')} WHERE tender_id IS NOT NULL GROUP BY 1),
j AS (SELECT f.*, d.source, r.title, r.tender_ref_no, r.duration, {rerank} AS rerank_score FROM f LEFT JOIN t ON t.tender_id = f.tender_id JOIN {current_sql('tender_documents')} d ON d._id = coalesce(t.theirs, f.own) LEFT JOIN {current_sql('raw_tenders')} r ON r._id = d.tender_id WHERE d.expires_at IS NULL OR d.expires_at > TIMESTAMP '{NOW}')
SELECT profile, tender_id, own AS document_id, chunk_index::INT AS chunk_index, score, rerank_score, rerank_score AS final_score, title, tender_ref_no, duration, source FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY rerank_score DESC, id) AS p FROM j) WHERE p <= {K}"""


ORACLE = {
    "vector_norms": f"WITH {_BASE} SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM base",
    "normalised_vectors": f"WITH {MEANS_SQL} SELECT profile, d::INT AS dim, round(x / sqrt(s), 6) AS x FROM (SELECT profile, unnest(v) AS x, unnest(range(64)) AS d, list_dot_product(v, v) AS s FROM means)",
    "label_mean_vector": f"WITH {_BASE} SELECT label, d::INT AS dim, round(x, 6) AS x FROM {_pool('base', 'label', 'avg')}",
    "label_max_vector": f"WITH {_BASE} SELECT label, d::INT AS dim, round(x, 6) AS x FROM {_pool('base', 'label', 'max')}",
    "mean_of_means": f"WITH {_FILES}, {MEANS_SQL}, m AS (SELECT DISTINCT profile_id, profile, v FROM files JOIN means USING (profile)) SELECT profile_id, d::INT AS dim, round(x, 6) AS x FROM {_pool('m', 'profile_id', 'avg')}",
    "profile_representatives": f"WITH {_FILES}, {REPS_SQL} SELECT profile_id, (row_number() OVER (PARTITION BY profile_id ORDER BY pos, nth) - 1)::INT AS place, profile, nth::INT AS nth FROM files JOIN reps USING (profile)",
    "first_profile_data": f"WITH {_FILES}, r AS (SELECT f.profile_id, f.pos, f.profile AS file_hash, e.profile_data IS NOT NULL AS has_data, len(e.representative_embeddings) > 0 AS has_vectors FROM files f JOIN {_CPE} e ON e.file_hash = f.profile), d AS (SELECT profile_id, min(pos) AS stop, min_by(file_hash, pos) AS data_file FROM r WHERE has_data GROUP BY 1), v AS (SELECT r.profile_id, min_by(file_hash, pos) AS vector_file FROM r LEFT JOIN d USING (profile_id) WHERE has_vectors AND (stop IS NULL OR pos <= stop) GROUP BY 1) SELECT profile_id, data_file, vector_file FROM d FULL JOIN v USING (profile_id)",
    "representatives_given_labels": f"WITH {_BASE}, c AS (SELECT label, d, avg(x) AS c FROM (SELECT label, unnest(v) AS x, unnest(range(64)) AS d FROM base) GROUP BY 1, 2), f AS (SELECT label, id, round(sqrt(sum((x - c) * (x - c))), 9) AS distance FROM (SELECT label, id, unnest(v) AS x, unnest(range(64)) AS d FROM base) JOIN c USING (label, d) GROUP BY 1, 2) SELECT label, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, id) AS n FROM f) WHERE n = 1",
    "knn_top5": f"WITH {_BASE}, q AS (SELECT id AS qid, v FROM base) SELECT qid, id, round(distance, 6) AS distance, place::INT AS place FROM {_near('q', 'base', K)}",
    "knn_per_representative": f"WITH {_BASE}, {REPS_SQL}, q AS (SELECT profile || '|' || nth AS qid, v FROM reps) SELECT qid, id, round(distance, 6) AS distance, place::INT AS place FROM {_near('q', 'base', K)}",
    "multi_vector_similarity_max": f"{_SIM} SELECT profile, label, round(max(s), 6) AS similarity FROM sim GROUP BY 1, 2",
    "multi_vector_similarity_mean": f"{_SIM} SELECT profile, label, round(avg(s), 6) AS similarity FROM sim GROUP BY 1, 2",
    "multi_vector_similarity_weighted": f"{_SIM} SELECT profile, label, round(sum(s * s * s) / greatest(sum(s * s), 1e-10), 6) AS similarity FROM sim GROUP BY 1, 2",
    "embed_chunks": f"WITH RECURSIVE {_VEC} SELECT d::INT AS dim, count_if(x > 0)::BIGINT AS positive, count_if(x < 0)::BIGINT AS negative, round(max(x), 6) AS highest FROM (SELECT unnest(v) AS x, unnest(range(64)) AS d FROM vectors) GROUP BY 1",
    "mean_search_weighted": f"WITH RECURSIVE {_VEC}, {MEANS_SQL}, q AS (SELECT profile AS qid, v FROM means) SELECT profile, id, round(score, 6) AS score FROM ({_score(_near('q', 'vectors', K), 0.8)})",
    "query_search_weighted": f"WITH RECURSIVE {_VEC}, {_QVEC}, q AS (SELECT 'q' AS qid, v FROM qvec) SELECT profile, id, round(score, 6) AS score FROM ({_score(_near('q', 'vectors', 50), 0.9)})",
    "combined_vectors": f"WITH {MEANS_SQL}, {_QVEC}, m AS (SELECT profile, list_transform(list_zip(means.v, qvec.v), lambda x: (x[1] + x[2]) / 2) AS m FROM means, qvec) SELECT profile, d::INT AS dim, round(x / sqrt(s), 6) AS x FROM (SELECT profile, unnest(m) AS x, unnest(range(64)) AS d, list_dot_product(m, m) AS s FROM m)",
    "fuse_max": f"WITH {_BASE}, {REPS_SQL}, {MEANS_SQL}, a AS (SELECT profile || '|' || nth AS qid, v FROM reps), b AS (SELECT profile AS qid, v FROM means) SELECT profile, id, round(max(score), 6) AS score FROM ({_score(_near('a', 'base', K), 1.0, 'split_part(qid, chr(124), 1)')} UNION ALL {_score(_near('b', 'base', K), 0.8)}) GROUP BY 1, 2",
    "hybrid_search": _hybrid(False),
    "hybrid_search_with_query": _hybrid(True),
    "filtered_search": _hybrid(False, "(coalesce(d.source, r.source) IS NULL OR contains(lower(coalesce(d.source, r.source)), 'works'))"),
    "filtered_search_fields": _hybrid(False, "(coalesce(d.tender_ref_no, r.tender_ref_no) IS NULL OR contains(lower(coalesce(d.tender_ref_no, r.tender_ref_no)), '20')) AND (d.document_type IS NULL OR contains(lower(d.document_type), 'no'))"),
    "search_results": _hybrid(False).rpartition("\nSELECT ")[0] + "\nSELECT profile, owner AS document_id, round(score + boost, 4)::DOUBLE AS final_score, substr(document, 1, 350) AS tender_snippet, coalesce(array_to_string(list_sort(list_intersect(words, toks))[1:10], '|'), '') AS matched_keywords FROM b",
    "approximate_recall": f"WITH {_BASE} SELECT count(*) AS n_queries, true AS reached FROM base WHERE CAST(id AS BIGINT) % 50 = 0",
    "multi_vector_similarity_fallback": f"{_SIM}, {MEANS_SQL}, found AS (SELECT profile, label, max(s) AS s FROM sim GROUP BY 1, 2) SELECT profile, label, round(s, 6) AS similarity FROM found UNION ALL SELECT m.profile, l.id, round(1 - {distance_sql('m.v', 'l.v')}, 6) FROM means m, labels l WHERE m.profile NOT IN (SELECT profile FROM found)",
    "legacy_search": _legacy(False),
    "legacy_search_with_query": _legacy(True),
}
_OWN = f"(SELECT file_hash AS key, CASE WHEN relevant_text <> '' THEN relevant_text ELSE {combined_sql('text', 'tables')} END AS body FROM {current_sql('company_profile_outputs')})"
ORACLE["profile_snippet"] = f"""{_hybrid(False, k=1).partition(chr(10) + 'kw AS (')[0]}
hits AS (SELECT profile || '|' || id AS id, substr(document, 1, 350) AS document FROM best), {vectors_sql('hits', 'hit_vectors')},
own_bodies AS {_OWN}, {chunks_sql('own_bodies', 800, 100, 'own')}, own_chunks AS (SELECT 'profile:' || key || ':' || i AS id, key AS owner, chunk AS document FROM own), {vectors_sql('own_chunks', 'own_vectors')},
hit_asks AS (SELECT id AS qid, v FROM hit_vectors), found AS {_near('hit_asks', 'own_vectors', 5)},
first AS (SELECT qid, min_by(document, (place, id)) AS document FROM found JOIN own_chunks c USING (id) WHERE owner = split_part(qid, '|', 1) AND owner IN (SELECT profile FROM means) GROUP BY 1)
SELECT split_part(h.id, '|', 1) AS profile, substr(coalesce(f.document, ''), 1, 350) AS profile_snippet FROM hits h LEFT JOIN first f ON f.qid = h.id"""
