"""Files as rows with their hash, and a pluggable extractor of text, tables and sections."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTRACTED = "file_hash string, path string, success boolean, text string, tables array<string>, sections array<struct<title:string,text:string>>, error string"


class Extractor(Protocol):
    """Turns the bytes of a file into text, tables and sections."""

    def extract(self, content: bytes) -> dict[str, Any]: ...


class PlainText:
    """Takes UTF-8 text as it is, and JSON of the form text, tables, sections."""

    def extract(self, content: bytes) -> dict[str, Any]:
        text = content.decode("utf-8")
        if text.lstrip().startswith("{"):
            found = json.loads(text)
            return {"text": found.get("text"), "tables": [serialised(t) for t in found.get("tables") or []], "sections": [section(s) for s in found.get("sections") or []]}
        return {"text": text, "tables": [], "sections": []}


def serialised(value: Any) -> str:
    """A table as text: its own text, or the non-blank strings of a mapping; other values as JSON."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        if isinstance(value.get("text"), str):
            return value["text"]
        return "\n".join(v.strip() for v in value.values() if isinstance(v, str) and v.strip())
    return json.dumps(value, ensure_ascii=False, sort_keys=True, default=str)


def section(value: Any) -> dict[str, str | None]:
    """Title and text of a section, also under the names heading and content."""
    if not isinstance(value, dict):
        return {"title": None, "text": str(value)}
    return {"title": value.get("title") or value.get("heading"), "text": value.get("text") or value.get("content")}


def files(spark: SparkSession, folder: str, suffixes: Iterable[str] = (".pdf",)) -> DataFrame:
    """``(path, size_kb, file_hash, content)`` of the non-empty files with one of the suffixes, in any case; equal files once."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ends = F.lit(False)
    for suffix in suffixes:
        ends = ends | F.lower("path").endswith(suffix.lower())
    rows = rows.where(ends & (F.col("length") > 0)).select("path", F.round(F.col("length") / 1024, 2).alias("size_kb"), F.sha2("content", 256).alias("file_hash"), "content")
    return rows.dropDuplicates(["file_hash"])


def zipped(rows: DataFrame, per_archive: int = 500) -> DataFrame:
    """``rows(path, file_hash, content)`` as ``(archive, n_files, content)``: equal files once, by base name, a number before it where names clash."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held, seen = io.BytesIO(), {}
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
            for path, content in sorted(zip(pdf.path, pdf.content)):
                name = path.rsplit("/", 1)[-1]
                seen[name] = n = seen.get(name, 0) + 1
                out.writestr(name if n == 1 else f"{n}-{name}", bytes(content))
        return pd.DataFrame({"archive": [int(pdf.archive.iloc[0])], "n_files": [len(pdf)], "content": [held.getvalue()]})

    once = rows.dropDuplicates(["file_hash"])
    parts = max(1, -(-once.count() // per_archive))
    return once.withColumn("archive", F.pmod(F.xxhash64("file_hash"), F.lit(parts)).cast("int")).groupBy("archive").applyInPandas(run, "archive int, n_files int, content binary")


def extracted(rows: DataFrame, make: type = PlainText) -> DataFrame:
    """Extraction of ``rows(file_hash, path, content)``; a failure is a row with its error."""

    def run(batches):
        extractor = make()
        for pdf in batches:
            found = []
            for key, path, content in zip(pdf.file_hash, pdf.path, pdf.content):
                try:
                    x = extractor.extract(bytes(content))
                    found.append((key, path, True, x.get("text"), x.get("tables"), x.get("sections"), None))
                except Exception as failure:  # one bad file is a result, not the end of the job
                    found.append((key, path, False, None, None, None, str(failure)[:500]))
            yield pd.DataFrame(found, columns=["file_hash", "path", "success", "text", "tables", "sections", "error"])

    return rows.select("file_hash", "path", "content").mapInPandas(run, EXTRACTED)
