"""Sources, the job stream, the engine and the catalogue."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from matchloom.config import Config
from matchloom.operators.embed import backend, register
from matchloom.plans import catalogue
from matchloom.plans.engine import Engine
from matchloom.sources.files import extracted, files, serialised, zipped
from matchloom.sources.html import rows_of, table_rows
from matchloom.sources.profile_json import parsed_profile, processed
from matchloom.streaming.jobs import read_jobs, run_available


def test_html_rows(spark):
    cell = lambda *x: "<tr>" + "".join(f"<td>{v}</td>" for v in x) + "</tr>"
    page = "<table><tbody>" + cell("1", "R/1", " A &amp; B ", "<a href='/f.pdf'>x</a>", "7 days") + cell("2", "R/2", "no link", "x", "y") + cell("3", "short") + "</tbody></table><table><tbody>" + cell("9", "9", "9", "<a href='z'>z</a>", "9") + "</tbody></table>"
    assert rows_of(page) == [("1", "R/1", "A & B", "/f.pdf", "7 days")]
    assert rows_of(None) == rows_of("<p>none</p>") == rows_of("<table></table>") == []
    assert table_rows(spark.createDataFrame([("p", page), ("q", None)], "page string, html string")).count() == 1


def test_files_and_extraction(spark, tmp_path):
    (tmp_path / "a.PDF").write_text("text one")
    (tmp_path / "b.pdf").write_text("text one")
    (tmp_path / "c.pdf").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "d.pdf").write_text("")
    (tmp_path / "e.txt").write_text("other")
    (tmp_path / "f.pdf").write_text(json.dumps({"text": "t", "tables": [{"a": " x ", "b": 1}, "y"], "sections": [{"heading": "H", "content": "C"}]}))
    rows = files(spark, str(tmp_path))
    assert rows.count() == 3
    found = extracted(rows).collect()
    assert sorted(r.success for r in found) == [False, True, True]
    made = next(r for r in found if r.text == "t")
    assert made.tables == ["x", "y"] and made.sections[0].title == "H" and made.sections[0].text == "C"
    assert serialised({"text": ""}) == "" and serialised([1, {"b": None}]) == '[1, {"b": null}]'


def test_profile_json(spark):
    answers = ['```json\n{"company_name": "X", "industries": ["a"], "capabilities": "no list", "years_of_experience": 7}\n```', "no json", "[1]", None]
    rows = spark.createDataFrame([(a,) for a in answers], "a string").select(parsed_profile(F.col("a")).alias("p")).collect()
    assert rows[0].p.company_name == "X" and rows[0].p.industries == ["a"] and rows[0].p.years_of_experience == "7"
    assert [r.p for r in rows[1:]] == [None, None, None]


def test_job_stream(spark, tmp_path):
    jobs = tmp_path / "jobs"
    jobs.mkdir()
    for n, kind in enumerate(["match_search", None, "nonsense", "broken"]):
        (jobs / f"{n}.json").write_text(json.dumps({"job_id": str(n), "type": kind, "size_mb": 1.0}))

    def broken(rows):
        raise ValueError("no")

    handlers = {"profile_ingest": lambda x: x.select("job_id"), "match_search": lambda x: x.select("job_id"), "broken": broken}
    for _ in range(2):
        run_available(read_jobs(spark, str(jobs)), handlers, str(tmp_path / "out"), str(tmp_path / "state"))
    found = {r.job_id: r.status for r in spark.read.parquet(str(tmp_path / "out/status")).collect()}
    assert found == {"0": "done", "1": "done", "2": "failed", "3": "failed"}


def test_a_failing_job_does_not_take_others_with_it(spark, tmp_path):
    jobs = tmp_path / "jobs"
    jobs.mkdir()
    (jobs / "all.json").write_text("\n".join(json.dumps({"job_id": str(n), "type": "sum", "payload": p}) for n, p in enumerate(["1", "x", "3"])))
    called = []

    def total(rows):
        called.append(rows.count())
        return rows.select("job_id", F.col("payload").cast("int").alias("n"))

    run_available(read_jobs(spark, str(jobs)), {"sum": total, "never": None}, str(tmp_path / "out"), str(tmp_path / "state"))
    found = {r.job_id: (r.status, r.error is None) for r in spark.read.parquet(str(tmp_path / "out/status")).collect()}
    assert found == {"0": ("done", True), "1": ("failed", False), "2": ("done", True)} and called == [3, 1, 1, 1]


def test_engine(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "p.pdf").write_text("We supply cables and pumps to the harbour works.")
    engine = Engine(spark, str(tmp_path / "store"))
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    outputs = spark.createDataFrame([("d1", "tender", "t1", "Supply of cables and pumps", None, None), ("d2", "tender", "t2", "Museum paintings", None, None), ("d3", "tender", None, "", None, None), ("d4", "tender", None, "x", None, True)], "document_id string, doc_type string, tender_id string, text string, tables array<string>, indexed boolean")
    documents = spark.createDataFrame([(f"d{i}", f"t{i}", "s") for i in (1, 2, 3)], "_id string, tender_id string, source string").withColumns({c: F.lit(None).cast("string") for c in ("pdf_url", "local_path", "document_type", "document_name")} | {"expires_at": F.lit(None).cast("timestamp_ntz")})
    tenders = spark.createDataFrame([("t1", "T1", "R1", "s")], "_id string, title string, tender_ref_no string, source string").withColumn("duration", F.lit("1 day"))
    log = {r.document_id: r.index_status for r in engine.index_tenders(outputs, documents, now).collect()}
    assert log == {"d1": "indexed", "d2": "indexed", "d3": "empty"}
    assert engine.index_tenders(outputs, documents, now).count() == 3 and engine.count("tender_vectors") == 2
    found = engine.match(str(folder), documents, tenders, now, 2, query="pumps").orderBy("place").collect()
    assert found[0].document_id == "d1" and found[0].title == "T1"
    assert engine.add_files(str(folder)).count() == 1
    with pytest.raises(LookupError):
        engine.read("nothing")


def test_pipeline_and_profiles(spark, tmp_path):
    for name, text in (("a.txt", "Supply of cables and pumps"), ("b.txt", "Museum paintings"), ("bad.txt", None)):
        (tmp_path / name).write_bytes(b"\xff\xfe" if text is None else text.encode())
    rows = [("d1", "pending", f"{tmp_path}/a.txt"), ("d2", "pending", f"{tmp_path}/b.txt"), ("d3", "pending", None), ("d4", "pending", f"{tmp_path}/none.txt"), ("d5", "pending", f"{tmp_path}/bad.txt"), ("d6", "done", f"{tmp_path}/a.txt")]
    documents = spark.createDataFrame(rows, "_id string, docling_status string, local_path string").withColumns({"tender_id": F.lit("t1"), "source": F.lit("s")} | {c: F.lit(None).cast("string") for c in ("pdf_url", "document_type", "document_name")} | {"expires_at": F.lit(None).cast("timestamp_ntz")})
    tenders = spark.createDataFrame([("t1", "T1", "R1", "s")], "_id string, title string, tender_ref_no string, source string").withColumn("duration", F.lit("1 day"))
    engine, now = Engine(spark, str(tmp_path / "store"), config=Config(snippet_chars=6)), F.lit("2024-01-01").cast("timestamp_ntz")
    assert {r.has_path: r["count"] for r in engine.run(documents, now, dry_run=True).collect()} == {True: 4, False: 1}
    assert {r.document_id: r.index_status for r in engine.run(documents, now).collect()} == {"d1": "indexed", "d2": "indexed"}
    log = {r._id: (r.docling_status, r.error is None) for r in engine.read("document_log").collect()}
    assert log == {"d1": ("done", True), "d2": ("done", True), "d3": ("failed", False), "d4": ("failed", False), "d5": ("failed", False)}
    folder, wrong = tmp_path / "in", tmp_path / "wrong"
    folder.mkdir(), wrong.mkdir()
    (folder / "p.pdf").write_text("We supply cables and pumps to the harbour works.")
    (wrong / "q.pdf").write_bytes(b"\xff\xfe")
    assert engine.create_profile("p|1", "c", str(folder), now).first().status == "READY"
    assert engine.create_profile("p2", None, str(wrong), now).first().status == "FAILED"
    found = engine.search_profile("p|1", documents, tenders, now, 2, query="pumps", filters={"tender_ref_no": "r1"}).orderBy("place").collect()
    assert found[0].document_id == "d1" and found[0].profile == "p|1" and found[0].because.tender_snippet == "Supply" and "pumps" in found[0].because.matched_keywords and found[0].keyword_boost > 0
    assert engine.search_profile("p|1", documents, tenders, now, filters={"tender_ref_no": "other"}).count() == 0
    for key, error in ((" ", ValueError), ("p3", LookupError), ("p2", RuntimeError)):
        with pytest.raises(error):
            engine.search_profile(key, documents, tenders, now)


def test_backends():
    assert backend() is backend("hashing")
    register("absent", int, lambda: False)
    assert backend("auto") is backend("hashing")
    for name, error in (("absent", RuntimeError), ("unknown", LookupError)):
        with pytest.raises(error):
            backend(name)


def test_archives(spark):
    import io
    import zipfile

    rows = spark.createDataFrame([("a/x.pdf", "1", b"one"), ("b/x.pdf", "2", b"two"), ("c/y.pdf", "1", b"one")], "path string, file_hash string, content binary")
    made = zipped(rows).collect()
    names = zipfile.ZipFile(io.BytesIO(bytes(made[0].content))).namelist()
    assert len(made) == 1 and made[0].n_files == 2 and len(names) == 2


def test_processed_profiles(spark):
    rows = spark.createDataFrame([("h1", '{"company_name": "X", "certifications": ["ISO 9001"], "industries": ["Defence"]}'), ("h2", "none")], "file_hash string, answer string")
    found = {r.file_hash: r for r in processed(rows).collect()}
    assert found["h1"].success and found["h1"].filter_metadata.has_iso_9001 and found["h1"].filter_metadata.is_defense and "X" in found["h1"].searchable_text
    assert not found["h2"].success and found["h2"].searchable_text is None


def test_catalogue_has_oracles():
    weaker = set(catalogue.QUERIES) - set(catalogue.ORACLE)
    assert weaker == {"kmeans_representatives", "distinct_sketch"} and set(catalogue.ORACLE) <= set(catalogue.QUERIES)


def test_core_stands_without_the_subpackage():
    code = "import sys; sys.modules['matchloom.llm'] = None; import __spark_entry__ as e; assert 'hybrid_search' in e.queries() and not [k for k in e.queries() if k.startswith('p1_')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])


NAMES = ["chunk_documents", "hybrid_search", "upsert_tenders", "merge_outputs", "explain_match", "knn_top5", "stream_job_counts", "window_lag", "relevant_text", "missing_parent_status"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_agree_with_their_sql(spark, sf, name):
    import os

    import duckdb

    base = duckdb.connect()
    for file in os.listdir(sf):
        base.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{file}')")
    ours, theirs = catalogue.QUERIES[name](spark, sf).toPandas(), base.sql(catalogue.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    rows = lambda d: sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(ours) == rows(theirs)
