"""The functions under names of their own in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from matchloom.functions.text import chunks_of
from matchloom.session import ship

# Plain SQL bodies, which the optimiser sees through.
BODIES = {
    "tokenize(t STRING) RETURNS ARRAY<STRING>": "transform(regexp_extract_all(coalesce(t, ''), '[A-Za-z0-9]+', 0), x -> lower(x))",
    "vector_norm(v ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt(aggregate(v, 0D, (s, x) -> s + x * x))",
    "dot_product(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "cosine_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "CASE WHEN vector_norm(a) * vector_norm(b) > 0 THEN 1 - dot_product(a, b) / (vector_norm(a) * vector_norm(b)) ELSE 1D END",
    "vector_similarity(d DOUBLE) RETURNS DOUBLE": "coalesce(greatest(0D, 1 - d), 0D)",
    "keyword_overlap(q STRING, t STRING) RETURNS DOUBLE": "CASE WHEN size(tokenize(q)) > 0 THEN size(array_intersect(tokenize(q), tokenize(t))) / size(array_distinct(tokenize(q))) ELSE 0D END",
}


def register(spark: SparkSession) -> None:
    """Makes ``tokenize``, ``chunk_text``, ``cosine_distance`` and the others known to SQL in this session."""
    ship(spark)
    for head, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.pandas_udf("array<string>")
    def chunk_text(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, most, overlap in batches:
            yield pd.Series([chunks_of(t, int(m), int(o)) for t, m, o in zip(texts, most, overlap)])

    spark.udf.register("chunk_text", chunk_text)
