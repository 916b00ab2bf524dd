"""Column functions against plain statements of their rules."""

import re

from urllib.parse import urljoin

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.functions import extract, profiles, text, vectors


def one(spark, **columns):
    """A row of literal values."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_tokens(spark):
    row = one(spark, a=text.tokenize(F.lit("Café ISO-9001 iso")), b=text.token_set(F.lit("a A b")), c=text.tokenize(F.lit(None).cast("string")))
    assert (row.a, row.b, row.c) == (["caf", "iso", "9001", "iso"], ["a", "b"], [])


@pytest.mark.parametrize(
    ("value", "most", "overlap", "expected"),
    [("a\nb", 10, 0, ["a b"]), ("x" * 1200, 500, 0, ["x" * 500, "x" * 500, "x" * 200]), ("", 500, 80, []), (None, 500, 80, []), ("abc", 0, 0, []), ("one two\nthree four", 10, 5, ["one two", "two three four"]), ("aa bb cc\ndd ee", 9, 5, ["aa bb cc", "cc dd ee"])],
)
def test_chunks(value, most, overlap, expected):
    assert text.chunks_of(value, most, overlap) == expected


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n\r\t\xa0", max_size=300), st.integers(1, 40), st.integers(0, 20))
def test_chunks_keep_their_bounds(value, most, overlap):
    chunks = text.chunks_of(value, most, overlap)
    assert all(c and c == c.strip() and len(c) <= overlap + 1 + most for c in chunks)
    assert set(re.findall("[ab]", value)) == set(re.findall("[ab]", "".join(chunks)))


def test_chunk_udf_takes_nulls(spark):
    rows = spark.createDataFrame([(1, "a\nb"), (2, None), (3, "")], "k int, t string")
    assert {r.k: r.c for r in rows.select("k", text.chunk_text(F.col("t"), 10, 0).alias("c")).collect()} == {1: ["a b"], 2: [], 3: []}


@pytest.mark.parametrize(("words", "expected"), [(["x", "y"], 0.0), (["a", "w", "x", "y"], 0.1), (["a", "b"], 0.2), (["a", "y"], 0.2), ([], 0.0)])
def test_boost(spark, words, expected):
    array = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    assert one(spark, b=text.keyword_boost(array, F.lit("a b c"))).b == pytest.approx(expected)


def test_ids_links_and_strip(spark):
    row = one(
        spark, i=text.chunk_id("tender", F.lit("d"), F.lit(3)), p=text.parsed_chunk_id(F.lit("tender:d:3")), q=text.parsed_chunk_id(F.lit("profile:d:3")), z=text.parsed_chunk_id(F.lit("x")),
        r=text.resolved(F.lit("https://h.example/a/b"), F.lit("/c/d.pdf")), s=text.resolved(F.lit("https://h.example/a/b"), F.lit("d.pdf")), n=text.base_name(F.lit("a/b/c.pdf")), t=text.strip(F.lit("  x \n")),
    )
    assert tuple(row) == ("tender:d:3", "d", None, None, "https://h.example/c/d.pdf", "https://h.example/a/d.pdf", "c.pdf", "x")


LINKS = ["a.pdf", "../a.pdf", "../../../a.pdf", "./a.pdf", "/x/../a.pdf", "//c.example/a.pdf", "?q=1", "#top", "", "https://o.example/z", "mailto:x@y.example", "d/", "..", "a.pdf?x=../y#z"]


@pytest.mark.parametrize("base", ["https://host.example", "https://host.example/", "https://host.example/list/page/index.html?p=2#f", "https://host.example/a/b/"])
def test_links_resolve_by_the_standard(spark, base):
    rows = spark.createDataFrame([(x,) for x in LINKS], "link string").select("link", text.resolved(F.lit(base), F.col("link")).alias("full")).collect()
    assert {r.link: r.full for r in rows} == {x: urljoin(base, x) for x in LINKS}


def test_filters(spark):
    rows = spark.createDataFrame([("Works Dept", "t"), (None, "works"), (None, None), ("other", "works")], "a string, b string")
    kept = rows.where(text.filters_pass({"source": "WORKS", "title": "", "unknown": "x", "none": None}, {"source": F.col("a")}, {"source": F.col("b")}))
    assert kept.count() == 3


def test_relevant_text(spark):
    row = one(spark, e=extract.relevant_text(F.lit(None).cast("string"), F.lit(None).cast("array<struct<title:string,text:string>>"), F.lit(None).cast("array<string>")))
    assert row.e == ""
    sections = F.expr("array(named_struct('title', 'Company Overview!', 'text', 'first body'), named_struct('title', 'Irrelevant', 'text', 'second body'), named_struct('title', 'Our Capabilities', 'text', cast(null as string)))")
    tables = F.array(F.lit("client list with contract value"), F.lit("iso"), F.lit("nothing here at all, not at all"))
    row = one(spark, e=extract.relevant_text(F.lit("head."), sections, tables), short=extract.relevant_text(F.lit("ab. " * 30), F.lit(None).cast("array<struct<title:string,text:string>>"), F.lit(None).cast("array<string>"), most=10))
    assert row.e == "head.\n\n\n### Company Overview!\nfirst body\n\n\n\n--- Tables ---\n\n\n\n[Table]\nclient list with contract value"
    assert row.short == "ab. ab. ab"


def test_stats(spark):
    stats = extract.extraction_stats(F.lit("a" * 10_000), F.lit("b" * 1_000))
    row = one(spark, **stats)
    assert (row.original_chars, row.extracted_chars, row.reduction_ratio, row.original_pages) == (10_000, 1_000, 0.9, 3)


def test_profile_functions(spark):
    shape = "profile_data struct<company_name:string,industries:array<string>,capabilities:array<string>,certifications:array<string>,project_types:array<string>,past_clients:array<string>,geographic_focus:array<string>,company_size:string,key_technologies:array<string>,domain_expertise:array<string>,years_of_experience:string,notable_projects:array<string>,summary:string>"
    data = ("Test Corp", ["Information Technology", None], ["Software Development", "Cloud Migration"], ["ISO 9001", "CMMI Level 5"], None, None, ["Pan India"], "large", ["Python", "AWS"], None, "15+", ["a", "b"], None)
    rows = spark.createDataFrame([(data,)], shape)
    flags = rows.select(*[c.alias(n) for n, c in profiles.flags("profile_data").items()]).first()
    assert flags.company_size == "large" and flags.has_iso_9001 and flags.has_cmmi and flags.is_it_company and flags.operates_pan_india and not flags.has_iso_27001 and flags.years_of_experience is None
    row = rows.select(profiles.searchable_text("profile_data").alias("t"), profiles.keywords("profile_data").alias("k")).first()
    assert row.t.startswith("Company: Test Corp\nIndustries: Information Technology\n") and row.t.endswith("Notable projects: a; b")
    assert {"software", "python", "aws", "software development"} <= set(row.k)


def test_vectors(spark):
    a, b, zero = (F.array(*map(F.lit, x)) for x in ([3.0, 4.0], [4.0, 3.0], [0.0, 0.0]))
    row = one(spark, n=vectors.norm(a), u=vectors.normalised(a), z=vectors.normalised(zero), d=vectors.cosine_distance(a, b), e=vectors.cosine_distance(a, zero), s=vectors.similarity(F.lit(1.5)), c=vectors.combined(a, F.lit(None).cast("array<double>")))
    assert (row.n, row.u, row.z, row.e, row.s, row.c) == (5.0, [0.6, 0.8], [0.0, 0.0], 1.0, 0.0, [3.0, 4.0])
    assert row.d == pytest.approx(1 - 24 / 25)


def test_usable_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0])], "k int, v array<double>")
    assert [r.k for r in rows.where(vectors.usable(F.col("v"), 2)).collect()] == [1]


def test_fences(spark):
    row = one(spark, a=extract.without_fences(F.lit('```json\n{"a": 1}\n```')), b=extract.without_fences(F.lit(' {"a": 1} ')))
    assert tuple(row) == ('{"a": 1}', '{"a": 1}')
