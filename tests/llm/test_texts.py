"""Pieces, site lines, scans, canonical values, packing and mixing."""

import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.llm import canonical, mixture, packing, pieces, scans, site_lines, tokens


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\né", max_size=400), st.integers(20, 60), st.integers(0, 10))
def test_pieces_round_trip(text, limit, overlap):
    cut, _ = pieces.cut(text, limit, overlap)
    if len(text) <= limit:
        assert cut == []
        return
    assert cut[0][0] == 0 and cut[-1][1] == len(text) and all(0 < b - a <= limit for a, b, _ in cut)
    whole = text[: cut[0][1]] + "".join(text[a + overlap : b] for a, b, _ in cut[1:])
    assert whole == text and all(y[0] == x[1] - overlap for x, y in zip(cut, cut[1:]))
    for a, b, kind in cut[:-1]:
        assert kind == "hard" or text[b - 1].isspace()
        if kind == "hard":
            done = a + overlap if a else 0
            assert not any(text[i].isspace() for i in range(done + 1, a + limit - 1) if not text[i + 1].isspace() and i + 1 > done + 1)


def test_pieces_prefer_strong_boundaries():
    text = "word " * 8 + "end.\n\n" + "word " * 20
    assert pieces.cut(text, 60, 5)[0][0] == (0, 46, "paragraph")
    with pytest.raises(ValueError):
        pieces.cut("x", 5, 5)


def test_p5(spark, tmp_path):
    rows = [("a", "x" * 4001, None), ("a", "x" * 4001, None), ("b", "y " * 2500, ["short", "z" * 3000 + " " + "z" * 3000, None]), ("c", None, None), ("d", "", []), ("e", "x" * 4000, []), (None, "x" * 9000, [])]
    spark.createDataFrame(rows, "document_id string, text string, tables array<string>").write.parquet(f"{tmp_path}/docling_outputs.parquet")
    assert {tuple(r) for r in pieces.p5_found(spark, str(tmp_path)).collect()} == {("a", "text", 0, 1), ("b", "text", 0, 0), ("b", "tables", 1, 0)}
    assert pieces.p5_pieces(spark, str(tmp_path)).where("document_id = 'a'").count() == 2


def brute_lines(rows, least_documents=6, share=0.05):
    documents, lines = defaultdict(set), defaultdict(set)
    for document, source, text in rows:
        if document is None or source is None:
            continue
        documents[source].add(document)
        for n, raw in enumerate((text or "").split("\n"), 1):
            if sum(map(str.isalpha, raw)) >= 15:
                lines[source, site_lines.normal(raw)].add((document, n))
    found = set()
    for (source, _), places in lines.items():
        n = len({d for d, _ in places})
        if n >= least_documents and n >= share * len(documents[source]):
            found |= places
    return found


@pytest.mark.parametrize("held", [200_000, 0])
def test_site_lines_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(site_lines, "HELD_LEAVES", held)
    r = random.Random(2)
    notes = ["Share this notice with a colleague 12", "SHARE THIS NOTICE  with a colleague 7\r", "Printed on page 4 of the official portal", "too short", "All rights reserved by the portal of works"]
    rows = []
    for d in range(160):
        body = [f"Delivery of {r.choice('abcdefgh') * 5} items number {r.randrange(10**6)} for the depot {r.random()}" for _ in range(4)]
        body += [n for n in notes if r.random() < (0.05 if "All" in n else 0.3)]
        r.shuffle(body)
        rows.append((f"d{d}", ["one", "two", None][d % 3 if d % 9 == 0 else d % 2], "\n".join(body)))
    rows += [rows[0], rows[1], ("n1", "one", None), ("n2", "two", ""), (None, "one", notes[0])]
    table = spark.createDataFrame([(*x, "x") for x in rows], "document_id string, source string, text string, line string")
    found, templates = site_lines.repeated_lines(table)
    assert {(x.document_id, x.line_no) for x in found.collect()} == brute_lines(rows) != set()
    assert templates.count() > 0
    assert site_lines.repeated_lines(table.limit(0))[0].count() == 0


def test_templates_get_slots():
    tree = site_lines.Templates(0.6)
    at = [tree.add(line) for line in ("share with a friend today", "share with a colleague today", "quite another line is here")]
    assert at == [0, 0, 1] and [tree.text(k) for k in (0, 1)] == ["share with a <*> today", "quite another line is here"]
    strict = site_lines.Templates(1.0)
    assert [strict.add(x) for x in ("share with a friend", "share with a colleague", "share with a friend")] == [0, 1, 0]


def test_templates_count_documents_once(spark):
    rows = [(f"d{i}", "one", "share this page with a friend today\nshare this page with a colleague today") for i in range(3)]
    rows += [(f"e{i}", "one", "share this page with a neighbour today") for i in range(2)]
    table = spark.createDataFrame(rows, "document_id string, source string, text string")
    assert site_lines.repeated_lines(table, similar=0.6)[1].count() == 0
    found, templates = site_lines.repeated_lines(table, 5, 0.05, 0.6)
    assert [tuple(r) for r in templates.collect()] == [("one", "share this page with a <*> today", 5)] and found.count() == 8


def test_folding_is_blind_to_look_alikes():
    for read, printed in [("@", "a"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("7", "t"), ("(", "c"), ("c", "e"), ("f", "t"), ("q", "g"), ("y", "v"), ("b", "h"), ("rn", "m"), ("cl", "d"), ("ri", "n"), ("ii", "u"), ("vv", "w")]:
        assert scans.folded(f"xx{read}yy") == scans.folded(f"xx{printed}yy"), (read, printed)


SCAN = """Repair of cables at Northport
The paying authority shall check the insu-
lated cables of the depot with-
Page 1 of 3
Ref: AB/2024/0001 | Northport
out delay and carry the heavy-
duty pumps.
2020.
Page 2 of 3
Ref: AB/2024/OOO1 | Northport
The wo1kers sha1l carry the pumps to the dcpot.
Page 3 of 3"""


def scanned(spark, extra=()):
    common = "the paying authority shall check the insulated cables of the depot without delay and carry the heavy-duty pumps shall depot " * 30
    # the evidence: three words and more in which the corpus shows each of two confusions
    shown = "authorify becomes autho1rity in no text but insu1ated cab1es de1ay sha1l and cabIes do not; chcck dclay hcavy thc"
    rows = [("s", SCAN), ("s", SCAN), ("c1", common), ("c2", common), ("v", shown), ("n", None), ("e", ""), (None, SCAN), *extra]
    return spark.createDataFrame([(k, t, "x") for k, t in rows], "record_key string, text string, word string")


def test_scan_defects(spark):
    found = {tuple(r)[1:4] for r in scans.defects(scanned(spark)).where("record_key = 's'").collect()}
    assert found == {
        (2, "hyphen", "insulated"), (3, "hyphen", "without"), (6, "hyphen", "heavy-duty"), (4, "page_no", ""), (9, "page_no", ""), (12, "page_no", ""),
        (5, "header", ""), (10, "header", ""), (11, "char", "shall"), (11, "char", "depot"),
    }
    assert scans.defects(scanned(spark).limit(0)).count() == 0


def test_marks_are_read_within_their_query(spark, monkeypatch):
    # the shuffle files of a query go when its call returns, which for an iterator is before its rows are read
    def later(*_):
        raise AssertionError("read after its shuffle files are deleted")

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", later)
    assert scans.defects(scanned(spark)).where("record_key = 's' AND defect = 'char'").count() == 2


PRINTED = "engine bridge drainage garden gravel bargain harbour market timber number member summer camp hammer helmet channel chapter hospital anchor".split()


def test_confusions_come_from_the_corpus(spark):
    rows = [(f"c{k}", " ".join(PRINTED)) for k in range(40)]
    wrong = {(f"w{k}-{a}{b}", w.replace(a, b, 1), w) for k, w in enumerate(PRINTED) for a, b in (("g", "9"), ("m", "nn"), ("h", "li"), ("e", "€")) if a in w}
    rows += [(key, read) for key, read, _ in wrong] + [("odd", "gardon anehor"), ("two", "bar9€in 9ard€n")]
    found = {tuple(r) for r in scans.defects(spark.createDataFrame(rows, "record_key string, text string")).select("record_key", "repaired").collect()}
    # two confusions in one word are repaired too; a letter that only one word shows is no confusion
    assert found == {(key, w) for key, _, w in wrong} | {("two", "garden")}


def test_words_of_any_length(spark):
    long = "".join(random.Random(4).choices("abcdefghijklmnopqrstuvwxyz", k=30_000))
    rows = [("a", f"{long} {long}"), ("b", long), ("c", f"{long[:-1]}9 " * 2), ("d", "x" * 50_000)]
    found = scans.defects(spark.createDataFrame(rows, "record_key string, text string")).collect()
    assert found == []
    held = spark.createDataFrame([("abc", 7, 1)], "word string, hash long, id long")
    assert {(r["at"], r.taken) for r in scans._differences(held).collect()} == {(1, "a"), (2, "b"), (3, "c"), (1, "ab"), (2, "bc")}


def test_breaks_go_on_behind_any_number_of_empty_lines():
    lines = ["the insu-", *[""] * 40, "lated cables", "and a depot with-", "out delay"]
    assert [x[:4] for x in scans.breaks(lines, {})] == [(0, "insu", "lated", 41), (0, "insu", "and", 42), (0, "insu", "out", 43), (42, "with", "out", 43)]


def test_long_tables_of_numbers_take_linear_time():
    lines = [str(k % 900) for k in range(60_000)]
    began = time.time()
    scans.furniture(lines)
    assert time.time() - began < 10


def test_scan_repair():
    found = [dict(line_no=a, defect=b, repaired=c, read=d) for a, b, c, d in ((2, "hyphen", "insulated", "insulated"), (3, "hyphen", "without", "without"), (4, "page_no", "", ""), (5, "header", "", ""), (11, "char", "shall", "sha1l"), (6, "hyphen", "heavy-duty", "heavyduty"), (9, "page_no", "", ""), (10, "header", "", ""), (12, "page_no", "", ""), (11, "char", "depot", "dcpot"))]
    text = scans.repaired(SCAN, found)
    assert text == "Repair of cables at Northport The paying authority shall check the insulated cables of the depot without delay and carry the heavy-duty pumps. 2020. The wo1kers shall carry the pumps to the depot."


def test_page_numbers_need_a_form_or_a_sequence():
    lines = ["A text that begins here", "1", "more text of the page", "and more", "and more", "2", "the text goes on", "x", "x", "2023.", "7"]
    assert scans.furniture(lines) == {1: "page_no", 5: "page_no"}
    assert set(scans.furniture(["text", "- 4 -", "text", "[5]", "p. 6", "Pagc l of 9", "7 | P a g e"])) == {1, 3, 4, 5, 6}


def osa(a: str, b: str) -> int:
    """Edits with swaps of neighbours, by the textbook's table."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edits_and_deletion_neighbourhoods(spark):
    r = random.Random(8)
    pairs = [("large", "lagre"), ("small", "smaall"), ("abc", "abc"), ("scada", "sacda"), ("scada", "sda"), ("abc", "xyz"), ("a", "abcdefgh"), ("", "ab"), ("x", "")]
    for _ in range(400):
        a = "".join(r.choices("abcd", k=r.randrange(1, 14)))
        b = list(a)
        for _ in range(r.randrange(4)):
            k, what = r.randrange(len(b) + 1), r.randrange(4)
            b[k:k] = r.choice("abcd") if what == 0 else ""
            b[k : k + 1] = [r.choice("abcd")] if what == 1 else b[k : k + 1] if what else []
            b[k : k + 2] = b[k : k + 2][::-1] if what == 3 else b[k : k + 2]
        pairs.append((a, "".join(b)))
    table = spark.createDataFrame(pairs, "a string, b string")
    found = table.select("a", "b", canonical.edits(F.col("a"), F.col("b")).alias("n"), F.arrays_overlap(canonical.deletions(F.col("a")), canonical.deletions(F.col("b"))).alias("meet")).collect()
    for x in found:
        true = osa(x.a, x.b)
        # in sequences that need three swaps or edit a swapped letter again the two may differ by one
        assert x.n == true or abs(x.n - true) <= 1 and true >= 2, x
        assert x.meet or true > 3, x
    assert sum(x.n == osa(x.a, x.b) for x in found) >= 0.97 * len(found)


CASES = [
    ("certification", "ISO 9001:2015", 2000), ("certification", "iso9001", 2000), ("certification", "IOS 27001", 2001), ("certification", "iso 9999", -1), ("certification", "CMMI Level 9", -1), ("certification", "CMMI Lvl 3", 2006),
    ("client", "Works, Ministry River", 4000), ("client", "M O R W", 4000), ("client", "Min. of River Works", 4000), ("client", "a leading bank", -1), ("client", "-", -1), ("place", "near Varnpaur", 3000), ("place", "VarnaPur ", 3000), ("place", "moon base", -1),
]


def test_canonical_values(spark):
    entries = spark.createDataFrame(
        [(2000, "certification", "ISO 9001", []), (2001, "certification", "ISO 27001", ["ISMS 27001"]), (2006, "certification", "CMMI Level 3", ["CMMI L3"]), (4000, "client", "Ministry of River Works", ["MoRW"]), (3000, "place", "Varnapur", None), (None, "place", "Moon Base", [])],
        "canonical_id long, kind string, canonical string, short_forms array<string>",
    )
    values = spark.createDataFrame([(k, v) for k, v, _ in CASES] + [("size", "large"), CASES[0][:2]], "kind string, raw_value string")
    found = {(r.kind, r.raw_value): r.canonical_id for r in canonical.mapped(values, entries).collect()}
    assert found == {(k, v): i for k, v, i in CASES} | {("size", "large"): -1}
    assert canonical.mapped(values.limit(0), entries).count() == 0


def texts_of(spark, n=300):
    r = random.Random(3)
    rows = [(i, r.choice(["one", "two", "big", None, "untargeted"]), " ".join(r.choices(["alpha", "beta", "gamma", "delta", "works"], k=r.randrange(5, 700)))) for i in range(n)]
    rows += [(1000, "one", None), (1001, "one", ""), (1002, "big", "word " * 5000), rows[0]]
    return rows, spark.createDataFrame([(*x, "x") for x in rows], "key long, source string, text string, n_tokens string")


def test_packing_keeps_every_token(spark):
    rows, table = texts_of(spark)
    packed = packing.pack(table, 1024, 100).collect()
    sizes = {k: tokens.count(t) for k, _, t in rows if t}
    spans = defaultdict(list)
    filled = Counter()
    for r in packed:
        spans[r.doc_id].append((r.start_token, r.start_token + r.n_tokens))
        filled[r.container_id] += r.n_tokens
    assert max(filled.values()) <= 1024
    for key, size in sizes.items():
        own = sorted(spans[key])
        assert own[0][0] == 0 and own[-1][1] == size and all(a[1] == b[0] for a, b in zip(own, own[1:]))
        assert len(own) == (1 if size <= 1024 else -(-size // 1024))
    assert set(spans) == set(sizes)
    assert sum(filled.values()) / (1024 * len(filled)) > 0.9
    assert packing.pack(table.limit(0)).count() == 0


def test_packing_retrieves_over_the_whole_collection(spark):
    # 60 themes of 5 items that just fill a container; by a random deal into shards of 20 items hardly any theme is whole
    r = random.Random(5)
    rows = []
    for theme in range(60):
        own = [f"t{theme}x{j}" for j in range(12)]
        for k in range(5):
            text = " ".join(r.choices(own, k=40))
            rows.append((theme * 5 + k, text, tokens.count(text)))
    capacity = 5 * max(n for _, _, n in rows)
    table = spark.createDataFrame([x[:2] for x in rows], "key long, text string")
    themes = defaultdict(set)
    for x in packing.pack(table, capacity, 20).collect():
        themes[x.container_id].add(x.doc_id // 5)
    pure = sum(len(x) == 1 for x in themes.values())
    assert pure >= 0.5 * len(themes)


def test_mixture_reaches_its_shares(spark):
    rows, table = texts_of(spark)
    targets = spark.createDataFrame([("one", 0.5, 3), ("two", 0.3, 2), ("big", 0.1, 1), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed, report = mixture.mixture(table, targets, block_tokens=512)
    shares = {r.source: r for r in report.collect()}
    assert shares["absent"].actual_share == 0 and shares["absent"].tokens == 0
    for name, target in (("one", 0.5), ("two", 0.3), ("big", 0.1)):
        assert shares[name].actual_share == pytest.approx(target / 0.9, abs=0.05)
        assert shares[name].most_uses <= shares[name].max_repeats
    found = mixed.collect()
    assert len({(r.doc_id, r.repeat_no) for r in found}) == len(found) and {r.source for r in found} == {"one", "two", "big"}
    uses = Counter(r.doc_id for r in found)
    assert max(uses.values()) > 1 and 1002 in {k for k, s, t in rows if s == "big"}
    assert mixture.mixture(table.limit(0), targets)[0].count() == 0


def test_a_given_total_stops_at_the_caps(spark):
    _, table = texts_of(spark)
    targets = spark.createDataFrame([("one", 0.5, 1), ("two", 0.5, 1), ("none", None, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    _, report = mixture.mixture(table, targets, total_tokens=10_000_000)
    found = {r.source: r for r in report.collect()}
    assert found["one"].tokens == found["one"].available_tokens and found["one"].most_uses == 1 and found["none"].tokens == 0


def test_removal_goes_through_templates_at_the_strict_setting(spark, monkeypatch):
    """Lines are grouped by their leaves' templates in each partition and over partitions, also where all slots must agree."""
    used, grouped = [], site_lines._grouped
    monkeypatch.setattr(site_lines, "_grouped", lambda least: used.append(least) or grouped(least))
    repeated, near = "Page 7 of the public tender notice", "Page 7 of the public tender letter <*>"
    rows = [(f"d{i}", "s", f"{repeated}\nonly in document {'abcdefgh'[i] * 9}\n{near if i < 5 else ''}") for i in range(8)]
    found, templates = site_lines.repeated_lines(spark.createDataFrame(rows, "document_id string, source string, text string"))
    assert sorted((r.document_id, r.line_no) for r in found.collect()) == [(f"d{i}", 1) for i in range(8)]
    assert [(r.template, r.n_documents) for r in templates.collect()] == [("page 0 of the public tender notice", 8)]
    assert used == [1.0, 1.0]
