"""Jobs as a stream of files: routing, failures kept as rows, counts, and the latest status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.config import DEFAULTS
from matchloom.session import shared_folder

JOB = "job_id string, type string, size_mb double, payload string, at timestamp"
Handler = Callable[[DataFrame], DataFrame]


def read_jobs(spark: SparkSession, folder: str, schema: str = JOB, kind: str = "json", files: int = 1) -> DataFrame:
    """Jobs from the files of a folder, in the order of their arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(folder)


def routed(kind: Column, known: list[str], default: str = "profile_ingest") -> Column:
    """The handler of a job: its type, the default for null, ``failed`` for an unknown one."""
    return F.when(kind.isNull(), default).when(kind.isin(known), kind).otherwise("failed")


def mode(size_mb: Column, most: float = DEFAULTS.sync_mb) -> Column:
    """``sync`` for small uploads."""
    return F.when(size_mb <= most, "sync").otherwise("async")


def progress(done: Column, total: Column) -> Column:
    """Percentage after ``done`` of ``total`` steps, from 5 to 90."""
    return (5 + F.floor(done / F.greatest(total, F.lit(1)) * 85)).cast("int")


def run_available(jobs: DataFrame, handlers: dict[str, Handler], target: str, checkpoint: str) -> None:
    """Runs all jobs at hand through their handlers and appends ``(job_id, type, status, error)`` to ``target``.

    A micro-batch is written under its number, so that one that is repeated after a failure replaces its own rows. A
    handler takes all jobs of its type at once, and none if there are none. Where it fails, its jobs are run one by one, so
    that only those that fail by themselves are marked as failed; the stream goes on.
    """

    def attempt(handle: Handler, own: DataFrame, place: str) -> str | None:
        try:
            handle(own).write.mode("overwrite").parquet(place)
            return None
        except Exception as failure:  # a job's failure is its status
            return str(failure)[:500]

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("route", routed(F.col("type"), list(handlers))).persist()
        try:
            parts = [batch.where("route = 'failed'").select("job_id", "type", F.lit("failed").alias("status"), F.lit("unknown type").alias("error"))]
            for name, handle in handlers.items():
                own = batch.where(F.col("route") == name)
                if own.isEmpty():
                    continue
                if attempt(handle, own, f"{target}/results/{name}/batch={number}") is None:
                    parts.append(own.select("job_id", "type", F.lit("done").alias("status"), F.lit(None).cast("string").alias("error")))
                    continue
                ids = [r.job_id for r in own.select("job_id").distinct().toLocalIterator()]  # the jobs of one type in one micro-batch
                errors = [(x, attempt(handle, own.where(F.col("job_id") == x), f"{target}/results/{name}/batch={number}/job={k}")) for k, x in enumerate(ids)]
                told = batch.sparkSession.createDataFrame(errors, "job_id string, error string")
                parts.append(own.select("job_id", "type").join(told, "job_id").select("job_id", "type", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error"))
            every = parts[0]
            for part in parts[1:]:
                every = every.unionByName(part)
            every.write.mode("overwrite").parquet(f"{target}/status/batch={number}")
        finally:
            batch.unpersist()

    query = jobs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def document_state(known: Column, text: Column) -> Column:
    """``queued`` before there is an output, ``failed`` for one without text, ``done`` else."""
    return F.when(~F.coalesce(known, F.lit(False)), "queued").when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, "failed").otherwise("done")


def job_state(n_done: Column, n_failed: Column, n_all: Column) -> Column:
    """A job's state by its documents: it runs from the first ended document to the last, and fails only if all fail."""
    return F.when(n_all == 0, "done").when(n_done + n_failed == 0, "queued").when(n_done + n_failed < n_all, "running").when(n_done == 0, "failed").otherwise("done")


def gate(known: Column, status: Column) -> Column:
    """Whether a profile may be searched: 200 once it is ready, 409 before, 404 if there is none, 400 for a blank id."""
    return F.when(known.isNull(), 404).when(F.lower(F.trim(status)).eqNullSafe("ready"), 200).otherwise(409)


def latest_status(log: DataFrame, keys: list[str], at: str, order: str) -> DataFrame:
    """The last entry of each key in a status log."""
    others = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(at, order)).alias("_last")).select(*keys, "_last.*")


def counted_stream(spark: SparkSession, path: str, schema: str, keys: list[Column]) -> DataFrame:
    """Counts by ``keys`` of a folder read as a stream until all of it is done; the state lives in the shared folder."""
    import uuid

    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    counts = stream.groupBy(*keys).agg(F.count("*").alias("n"))
    target = f"{place}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    query = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target)
