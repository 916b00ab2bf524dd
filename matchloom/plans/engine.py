"""The public interface: ingest documents, build profiles, search, and run the whole pipeline over tables in a folder."""

from __future__ import annotations

import argparse
import sys

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.config import DEFAULTS, Config
from matchloom.functions import profiles as profile_functions
from matchloom.functions.extract import extraction_stats
from matchloom.operators import cluster, search, state
from matchloom.operators.documents import embedded_chunks, index_status, merged, profile_chunks, smart_text, tender_chunks
from matchloom.operators.embed import HashingEmbedder
from matchloom.operators.vectors import pooled
from matchloom.session import materialise, ship
from matchloom.sources.files import PlainText, extracted, files


class Engine:
    """Tables of one store folder; each write replaces a table as a whole, by a new version beside the old one."""

    def __init__(self, spark: SparkSession, store: str, config: Config = DEFAULTS, embedder: type = HashingEmbedder, extractor: type = PlainText):
        ship(spark)
        self.spark, self.store, self.config, self.embedder, self.extractor = spark, store.rstrip("/"), config, embedder, extractor

    # tables

    def _versions(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.store}/{name}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        marks = [(s.getPath(), s.getPath().getName()) for s in system.listStatus(path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[1:]) for p, n in marks if n.startswith("v") and system.exists(done(p, "_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        """The newest whole version of a table."""
        found = self._versions(name)
        if not found:
            raise LookupError(f"no table {name} in {self.store}")
        return self.spark.read.parquet(f"{self.store}/{name}/v{found[-1]}")

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Writes the next version of a table and reads it back."""
        number = (self._versions(name) or [0])[-1] + 1
        rows.write.mode("overwrite").parquet(f"{self.store}/{name}/v{number}")
        return self.read(name)

    def upsert(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """Replaces the rows of the keys that ``rows`` holds."""
        return self.write(name, state.replaced(self.read(name), rows, key) if self.exists(name) else rows)

    def forget(self, name: str) -> None:
        """Drops a table with all its versions."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.store}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def count(self, name: str) -> int:
        return self.read(name).count()

    # documents

    def add_files(self, folder: str, suffixes: tuple[str, ...] = (".pdf",)) -> DataFrame:
        """Extracts the files that are not stored yet."""
        new = files(self.spark, folder, suffixes)
        if self.exists("outputs"):
            new = new.join(self.read("outputs").select("file_hash"), "file_hash", "left_anti")
        done = extracted(new, self.extractor)
        done = materialise(done.withColumn("relevant_text", smart_text(done)))
        return self.upsert("outputs", done, "file_hash")

    def stats(self) -> DataFrame:
        """Sizes before and after the choice of relevant text."""
        return self.read("outputs").select("file_hash", *[c.alias(n) for n, c in extraction_stats(F.col("text"), F.col("relevant_text")).items()])

    def merged_outputs(self, owners: DataFrame) -> DataFrame:
        """One document for each of ``owners(profile_id, pos, file_hash)``."""
        return merged(owners.join(self.read("outputs"), "file_hash"), "profile_id")

    # profiles

    def build_profiles(self, owners: DataFrame) -> DataFrame:
        """Mean, maximum and representative vectors of each of ``owners(profile_id, file_hash)``; files already embedded are not embedded again."""
        outputs = self.read("outputs").where("success")
        if self.exists("profile_vectors"):
            outputs = outputs.join(self.read("profile_vectors").select(F.col("owner").alias("file_hash")).distinct(), "file_hash", "left_anti")
        chunks = materialise(embedded_chunks(profile_chunks(outputs, self.config), self.embedder))
        chosen = cluster.representatives(chunks.select("owner", "chunk_index", "vector"), self.config.representatives)
        chunks = chunks.join(chosen, ["owner", "chunk_index"], "left").withColumn("is_representative", F.col("place").isNotNull())
        vectors = self.upsert("profile_vectors", materialise(chunks), "owner")
        means = pooled(vectors, ["owner"])
        files_of = owners.select("profile_id", F.col("file_hash").alias("owner")).distinct()
        joined = files_of.join(means, "owner")
        result = pooled(joined, ["profile_id"]).withColumnRenamed("vector", "mean_embedding")
        highest = pooled(joined, ["profile_id"], how="max").withColumnRenamed("vector", "max_embedding")
        many = files_of.join(vectors.where("is_representative"), "owner").groupBy("profile_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("owner", "place", "vector"))), lambda x: x["vector"]).alias("representative_embeddings"))
        return self.write("profiles", result.join(highest, "profile_id").join(many, "profile_id", "left").join(files_of.groupBy("profile_id").agg(F.array_sort(F.collect_set("owner")).alias("file_hashes")), "profile_id"))

    def profile(self, profile_id: str) -> DataFrame:
        return self.read("profiles").where(F.col("profile_id") == profile_id)

    def create_profile(self, profile_id: str, company_id: str | None, folder: str, now, suffixes: tuple[str, ...] = (".pdf",)) -> DataFrame:
        """Takes in the files of a folder as a new profile, builds it, and tells its state; a profile whose files all fail is ``FAILED``."""
        self.add_files(folder, suffixes)
        owners = files(self.spark, folder, suffixes).select(F.lit(profile_id).alias("profile_id"), "file_hash")
        owners = materialise(owners)
        self.upsert("profile_files", owners, "profile_id")
        good = self.read("outputs").where("success").join(owners.select("file_hash"), "file_hash", "left_semi")
        ready = not good.isEmpty()
        if ready:
            self.build_profiles(self.read("profile_files"))
        row = owners.groupBy("profile_id").agg(F.array_sort(F.collect_set("file_hash")).alias("file_hashes"))
        row = row.select("profile_id", F.lit(company_id).cast("string").alias("company_id"), F.lit("READY" if ready else "FAILED").alias("status"), "file_hashes", now.alias("updated_at"))
        return self.upsert("profile_states", materialise(row), "profile_id").where(F.col("profile_id") == profile_id)

    def search_profile(self, profile_id: str, documents: DataFrame, tenders: DataFrame, now, k: int = 5, query: str | None = None, filters: dict | None = None, data: DataFrame | None = None) -> DataFrame:
        """Results for a stored profile: a blank id is a ValueError, an unknown one a LookupError, one that is not ready a RuntimeError."""
        if not profile_id or not profile_id.strip():
            raise ValueError("the profile id is blank")
        held = self.read("profile_states").where(F.col("profile_id") == profile_id).select("status").head() if self.exists("profile_states") else None
        if held is None:
            raise LookupError(f"no profile {profile_id}")
        if held.status != "READY":
            raise RuntimeError(f"profile {profile_id} is not ready")
        return self.search(self.profile(profile_id), documents, tenders, now, k, query, filters, data)

    # the pipeline

    def process_pending(self, documents: DataFrame, limit: int | None = None) -> DataFrame:
        """Extracts the pending ``documents(_id, tender_id, source, docling_status, local_path)`` that have no output yet.

        The outputs go to ``tender_outputs``, the new states (done, failed) of the documents to ``document_log``, which is
        returned. A document without path, or whose file is missing or cannot be read, has failed.
        """
        todo = documents.where("docling_status = 'pending'")
        if self.exists("document_log"):
            todo = todo.join(self.read("document_log").select("_id"), "_id", "left_anti")
        if limit and limit > 0:
            todo = todo.orderBy("_id").limit(limit)
        todo = materialise(todo.select("_id", "tender_id", "source", "local_path"))
        paths = todo.where("length(trim(local_path)) > 0").select("local_path").distinct()
        content = paths.mapInPandas(_contents, "local_path string, content binary")
        done = extracted(todo.join(content, "local_path").select(F.col("_id").alias("file_hash"), F.col("local_path").alias("path"), "content"), self.extractor)
        done = materialise(done.withColumnRenamed("file_hash", "document_id"))
        outputs = done.where("success").join(todo.select(F.col("_id").alias("document_id"), "tender_id", "source"), "document_id")
        outputs = outputs.select("document_id", F.lit("tender").alias("doc_type"), "tender_id", "source", "text", "tables", "sections", F.lit(False).alias("indexed"))
        self.upsert("tender_outputs", materialise(outputs), "document_id")
        status = F.when(F.col("success"), "done").otherwise("failed")
        error = F.when(F.coalesce("success", F.lit(False)), F.lit(None)).otherwise(F.coalesce("error", F.lit("no file")))
        log = todo.select("_id").join(done.select(F.col("document_id").alias("_id"), "success", "error"), "_id", "left").select("_id", status.alias("docling_status"), error.alias("error"))
        return self.upsert("document_log", materialise(log), "_id")

    def run(self, documents: DataFrame, now, limit: int | None = None, rebuild: bool = False, dry_run: bool = False) -> DataFrame:
        """Extracts what is pending and indexes what is extracted; a dry run only counts the pending documents by whether they have a path."""
        if dry_run:
            has_path = F.length(F.trim(F.coalesce("local_path", F.lit("")))) > 0
            return documents.where("docling_status = 'pending'").groupBy(has_path.alias("has_path")).count()
        self.process_pending(documents, limit)
        return self.index_tenders(self.read("tender_outputs"), documents, now, limit, rebuild)

    # tenders

    def index_tenders(self, outputs: DataFrame, documents: DataFrame, now, limit: int | None = None, rebuild: bool = False) -> DataFrame:
        """Chunks and vectors of the outputs not indexed yet, and their new flags in ``index_log``; ``limit`` bounds one run."""
        todo = outputs.where("doc_type = 'tender'")
        if not rebuild:
            todo = todo.where(state.pending())
            if self.exists("index_log"):
                todo = todo.join(self.read("index_log").select("document_id"), "document_id", "left_anti")
        if limit and limit > 0:
            todo = todo.orderBy("document_id").limit(limit)
        todo = materialise(todo.select("document_id", "doc_type", "tender_id", "text", "tables"))
        chunks = materialise(embedded_chunks(tender_chunks(todo, documents, now, self.config), self.embedder))
        self.write("tender_vectors", chunks) if rebuild else self.upsert("tender_vectors", chunks, "owner")
        counts = chunks.groupBy(F.col("owner").alias("document_id")).agg(F.count("*").cast("int").alias("chunk_count"))
        log = index_status(todo, documents, now).select("document_id", "index_status").join(counts, "document_id", "left")
        log = log.withColumn("index_status", F.when(F.col("chunk_count") > 0, "indexed").otherwise(F.col("index_status")))
        return self.write("index_log", log) if rebuild else self.upsert("index_log", materialise(log), "document_id")

    # search

    def _asking(self, profile_rows: DataFrame, data: DataFrame | None, query: str | None, filters: dict | None) -> search.Profiles:
        from matchloom.operators.embed import embedded

        vectors = profile_rows.select(F.col("profile_id").alias("profile"), F.posexplode("representative_embeddings").alias("nth", "vector"))
        means = profile_rows.select(F.col("profile_id").alias("profile"), F.col("mean_embedding").alias("vector"))
        words = data.select(F.col("profile_id").alias("profile"), profile_functions.keywords("profile_data").alias("keywords")) if data is not None else None
        questions = means.select("profile", F.lit(query).alias("query")).withColumn("vector", embedded(F.col("query"), self.embedder)) if query and query.strip() else None
        return search.Profiles(materialise(vectors), materialise(means), words, questions, filters or {})

    def search(self, profile_rows: DataFrame, documents: DataFrame, tenders: DataFrame, now, k: int = 10, query: str | None = None, filters: dict | None = None, data: DataFrame | None = None, hybrid: bool = True) -> DataFrame:
        """The best tenders of each profile: hybrid for profiles with representatives, by the mean vector for the others, ordered by final score."""
        corpus = search.Corpus(self.read("tender_vectors"), documents, tenders)
        full = F.size(F.coalesce("representative_embeddings", F.array().cast("array<array<double>>"))) > 0
        known = profile_rows.where(F.col("mean_embedding").isNotNull())
        parts = []
        shown = ["profile", "tender_id", "document_id", "score", "keyword_boost", "final_score", "source", "title", "tender_ref_no", "duration", "because"]
        for condition, run in ((full if hybrid else F.lit(False), search.hybrid), (~full if hybrid else F.lit(True), search.legacy)):
            rows = known.where(condition)
            if not rows.isEmpty():
                found = run(corpus, self._asking(rows, data, query, filters), now, k, self.config)
                for name in ("tender_snippet", "matched_keywords"):
                    found = found if name in found.columns else found.withColumn(name, F.lit("" if name == "matched_keywords" else None).cast("string"))
                parts.append(search.with_reasons(found.withColumn("keyword_boost", F.col("keyword_boost") if "keyword_boost" in found.columns else F.lit(0.0))).select(shown))
        if not parts:
            return self.spark.createDataFrame([], "profile string, tender_id string, document_id string, score double, keyword_boost double, final_score double, source string, title string, tender_ref_no string, duration string, because struct<tender_snippet: string, matched_keywords: array<string>>, place int")
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        place = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("final_score"), "document_id"))
        return every.withColumn("place", place)

    def match(self, folder: str, documents: DataFrame, tenders: DataFrame, now, k: int = 5, query: str | None = None, suffixes: tuple[str, ...] = (".pdf",)) -> DataFrame:
        """Files in a folder straight to results; each file is a profile."""
        self.add_files(folder, suffixes)
        hashes = files(self.spark, folder, suffixes).select("file_hash")
        owners = hashes.select(F.col("file_hash").alias("profile_id"), "file_hash")
        return self.search(self.build_profiles(materialise(owners)), documents, tenders, now, max(1, k), query)


def _contents(batches):
    """Contents of files on a path that all executors share; a file that cannot be read is left out."""
    for pdf in batches:
        found = []
        for path in pdf.local_path:
            try:
                with open(path.removeprefix("file://"), "rb") as file:
                    found.append((path, file.read()))
            except OSError:
                continue
        yield pd.DataFrame(found, columns=["local_path", "content"])


def main(arguments: list[str] | None = None) -> int:
    """Commands over a data folder and a store: ``index`` tender outputs, ``process`` pending documents, ``run`` both, ``profiles`` (re)builds them."""
    parser = argparse.ArgumentParser(prog="matchloom")
    parser.add_argument("data")
    parser.add_argument("store")
    parser.add_argument("--do", choices=["index", "process", "run", "profiles"], default="index")
    parser.add_argument("--now", required=True)
    parser.add_argument("--limit", type=int, default=0)
    parser.add_argument("--rebuild", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    options = parser.parse_args(arguments)
    from matchloom.plans.tables import current
    from matchloom.session import get_spark

    spark = get_spark()
    engine = Engine(spark, options.store)
    now = F.lit(options.now).cast("timestamp_ntz")
    if options.do == "profiles":
        owners = current(spark, options.data, "company_profiles", "file_hashes").select(F.col("_id").alias("profile_id"), F.explode("file_hashes").alias("file_hash"))
        outputs = current(spark, options.data, "company_profile_outputs").select("file_hash", "text", "relevant_text", "tables", "sections", (F.length(F.coalesce("text", F.lit(""))) > 0).alias("success"))
        if options.dry_run:
            outputs.groupBy("success").count().show()
            return 0
        if options.rebuild or not engine.exists("outputs"):
            engine.write("outputs", outputs)
            engine.forget("profile_vectors")
        engine.build_profiles(owners).select(F.count("*").alias("n_profiles")).show()
        return 0
    documents = current(spark, options.data, "tender_documents")
    if options.do in ("process", "run"):
        if options.dry_run:
            engine.run(documents, now, dry_run=True).show()
        elif options.do == "process":
            engine.process_pending(documents, options.limit).groupBy("docling_status").count().show()
        else:
            engine.run(documents, now, options.limit, options.rebuild).groupBy("index_status").count().show()
        return 0
    outputs = current(spark, options.data, "docling_outputs")
    if options.dry_run:
        index_status(outputs.where("doc_type = 'tender'").where(state.pending()), documents, now).groupBy("index_status").count().show()
        return 0
    engine.index_tenders(outputs, documents, now, options.limit, options.rebuild).groupBy("index_status").count().show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
