"""Every query of the corpus operators over empty tables, and over tables whose columns are null."""

import pytest
from pyspark.sql import functions as F

from matchloom.llm import catalogue

TABLES = {"docling_outputs": "document_id", "documents": "doc_id", "company_profile_embeddings": "file_hash", "company_profile_outputs": "file_hash", "canonical_values": "canonical_id", "mix_targets": "source"}


@pytest.fixture(scope="module")
def folders(spark, sf, tmp_path_factory):
    place = tmp_path_factory.mktemp("dirt")
    for name, key in TABLES.items():
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        rows.limit(0).coalesce(1).write.parquet(f"{place}/empty/{name}.parquet")
        nulls = rows.limit(3).select(*[F.col(c) if c == key else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
        lost = rows.limit(2).withColumn(key, F.lit(None).cast(rows.schema[key].dataType))
        nulls.unionByName(lost).withColumns({c: F.lit("clash") for c in ("key", "same", "n", "hash", "kind", "leaf", "line")} | ({"text": F.col("text")} if "text" in rows.columns else {})).coalesce(1).write.parquet(f"{place}/nulls/{name}.parquet")
    return place


REPORTS = {"p3_recall", "p7_report", "p8_shares"}
KEPT = {"p4_repaired", "p6_cleaned", "p9_shares"}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_empty_tables(spark, folders, name):
    rows = catalogue.QUERIES[name](spark, f"{folders}/empty").collect()
    assert not rows or name in REPORTS


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_null_columns(spark, folders, name):
    rows = catalogue.QUERIES[name](spark, f"{folders}/nulls").collect()
    assert not rows or name in REPORTS | KEPT
