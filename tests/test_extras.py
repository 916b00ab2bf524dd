"""SQL functions, approximate neighbours, progress and cache sweeps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.functions.sql import register
from matchloom.operators import approximate
from matchloom.operators.approximate import approximately_nearest, inverted
from matchloom.operators.state import swept
from matchloom.operators.vectors import nearest
from matchloom.streaming.progress import observed


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT tokenize('A b-C') t, chunk_text('one\\ntwo', 500, 80) c, cosine_distance(array(3D, 4D), array(4D, 3D)) d, cosine_distance(array(0D), array(1D)) z, keyword_overlap('a b', 'b c') k, keyword_overlap('', 'b') e, vector_similarity(1.5D) s").first()
    assert row.t == ["a", "b", "c"] and row.c == ["one two"] and row.d == pytest.approx(0.04) and (row.z, row.k, row.e, row.s) == (1.0, 0.5, 0.0, 0.0)


def test_approximate_neighbours(spark):
    random = np.random.default_rng(1)
    centres = random.normal(size=(10, 16))
    data = np.repeat(centres, 8, axis=0) + random.normal(size=(80, 16)) * 0.05
    corpus = spark.createDataFrame([(f"c{i:02}", v.tolist()) for i, v in enumerate(data)], "id string, vector array<double>")
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(centres)] + [("null", None)], "qid string, vector array<double>")
    index = inverted(corpus, 5)
    found = approximately_nearest(asked, index, 5).collect()
    assert len(found) == 50 and all(int(r.id[1:]) // 8 == int(r.qid[1:]) for r in found)
    assert approximately_nearest(asked, inverted(corpus.limit(0)), 5).count() == 0


def test_inverted_file_visits_few_cells_and_finds_most(spark, monkeypatch):
    monkeypatch.setattr(approximate, "CELL_ROWS", 50)
    monkeypatch.setattr(approximate, "BLOCK", 40)
    random = np.random.default_rng(2)
    data = np.repeat(random.normal(size=(60, 16)), 30, axis=0) + random.normal(size=(1_800, 16)) * 0.2
    corpus = spark.createDataFrame([(f"c{i:04}", v.tolist()) for i, v in enumerate(data)], "id string, vector array<double>")
    asked = corpus.where(F.col("id").substr(2, 4).cast("int") % 20 == 0).withColumnRenamed("id", "qid")
    index = inverted(corpus, 5, 0.97)
    met = nearest(asked, corpus, 5).select("qid", "id").join(approximately_nearest(asked, index, 5).select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    assert len(index.centres) == 36 and index.visits < 12 and met.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] >= 0.95


def test_observed_counts(spark):
    rows, counters = observed(spark.createDataFrame([(True,), (False,), (None,)], "success boolean"))
    rows.write.format("noop").mode("overwrite").save()
    assert counters.get == {"rows": 3, "good": 1}


def test_swept_cache(spark):
    cache = spark.sql("SELECT * FROM VALUES ('a', timestamp_ntz'2024-01-01'), ('b', timestamp_ntz'2024-02-01') AS t(key, cached_at)")
    now = F.lit("2024-02-02").cast("timestamp_ntz")
    for hours, kept in ((168, 1), (0, 2)):
        rows, gone = swept(cache, now, hours)
        assert rows.count() == kept and gone.first().removed == 2 - kept
