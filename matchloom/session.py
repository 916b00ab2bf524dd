"""Session set-up, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_written: list[tuple[SparkSession, str]] = []
#: Lets Spark delete the shuffle files of a query as soon as it has ended; what needs them again computes them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "matchloom", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the library relies on; explicit ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        CLEANUP: "true",
    } | conf
    spark = SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Prepares a session, also one made elsewhere: sends the package to the executors once for each context, so that their
    Python workers need no installation, and has shuffle files deleted with the query that wrote them."""
    context = spark.sparkContext
    if spark.conf.get(CLEANUP, "false") != "true":
        spark.conf.set(CLEANUP, "true")
    if getattr(context, "_matchloom_shipped", False):
        return
    context._matchloom_shipped = True
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="matchloom-")) / "matchloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a local one where that is unset (local mode)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="matchloom-")
        context.setCheckpointDir(folder)
    return folder or context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, with its lineage cut; survives the loss of executors."""
    ship(df.sparkSession)
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table into the shared folder and read again. Unlike ``materialise`` it keeps no
    partitioning, but takes less disk and gives back only the columns that are used."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _delete_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has been stopped
            return


def discard(*steps: DataFrame) -> None:
    """Deletes the files of materialised steps that nothing will read again, so that a query needs the disk of its largest
    step rather than of all. Files of other steps go with the session's cleaner."""
    for df in steps:
        if hasattr(df, "_stored_at"):
            _delete(df.sparkSession, df._stored_at)
            continue
        try:
            file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        except Exception:  # an inner interface: without it the cleaner deletes the files later
            continue
        if file.isDefined():
            _delete(df.sparkSession, file.get())


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hints a broadcast if ``df`` (already materialised) has at most ``rows`` rows; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
