"""Problem 4: repair of texts extracted from scanned pages.

Method: lines at the edges of pages are removed: page numbers by their form and their sequence, running headers by their
recurrence within the document once look-alike characters are folded together. The words of all texts are counted. The
corpus itself tells which strings are taken for which: taking one or two characters away from a word leaves a difference of
its anagram hash (the sum of the fifth powers of the character codes), and a rare and a frequent word that are left with the
same difference at the same place differ in those characters alone. Every such pair is evidence that the frequent word's
characters are read as the rare one's; confusions are ranked by the distinct frequent words that show them, and those with
enough are kept, whatever characters they hold. A rare word is then joined in SQL to frequent words whose anagram hash
differs from its own by the hash difference of one or two kept confusions; candidates that these confusions turn into each
other are ranked by the evidence for the confusions (its order of magnitude) and by frequency, and the best is the correction. A word broken at a line's end is joined with or without its
hyphen by which form the corpus holds more often.

The marks of words that need a correction are held in each task as a bitmap of fixed size; the exact words are joined by
Spark. Counts cover all texts.

Defined cases: null and empty texts have no defects; repeated rows of a key count once; a line that holds a break and the
next lines are furniture is joined to the first line of running text after them; a word with no frequent look-alike stays.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import materialise, table

#: Distinct frequent words that must show a confusion, in all and as a share of the confusion that most words show.
LEAST_SUPPORT, LEAST_SUPPORT_SHARE = 3, 0.01
#: Lines of running text after a broken word among which the one that goes on is looked for.
GO_ON_LINES = 3
#: Characters without which a line is no header, and above which one (white space counted once) is no page number of any form.
LEAST_HEADER, MOST_PAGE_NUMBER = 8, 24
#: A frequent word must be this many times as frequent as its misreading, for readings with a sign no word holds, and others.
ODD_RATIO, PLAIN_RATIO = 2, 15
LEAST_FREQUENT = 3
BITS = 1 << 22
#: Character codes are taken modulo the first, sums of fifth powers modulo the second number, which keeps them within 64 bits.
CODES, WRAP = 1 << 12, 1 << 61
#: Signs other than letters that are found in words as misreadings.
SIGNS = "0-9@!($|€£"
HYPHENS = "-‐‑\xac\xad"

_N = r"[0-9lio!|]{1,4}"
_PAGE = r"(?:p[a@][gq][ec]|pg|p)"
STRONG = re.compile(rf"(?:{_PAGE}[\s.]*{_N}(?:\s*[o0][ft]\s*{_N}|\s*/\s*{_N})?|\[\s*{_N}\s*\]|[-–—~]\s*{_N}\s*[-–—~]|{_N}\s*\|\s*p\s*[a@]\s*[gq]\s*[ec])")
WEAK = re.compile(r"[0-9]{1,4}|\([0-9]{1,4}\)|[ivxlc]{1,7}|[0-9]{1,4}\s*(?:of|/)\s*[0-9]{1,4}")
PAGE_PART = re.compile(rf"\s+{_PAGE}\.?\s*{_N}(?:\s*[o0][ft]\s*{_N})?\s*$|^\s*{_PAGE}\.?\s*{_N}(?:\s*[o0][ft]\s*{_N})?\s+(?=\S)")
#: For headers, which are compared before any word is counted: every character as the string that it shares with its look-alikes; a look-alike of two characters spells both out.
_ALIKE = str.maketrans({
    "0": "o", "1": "l", "i": "l", "!": "l", "|": "l", "5": "s", "@": "a", "(": "c", "e": "c", "6": "b", "h": "b", "f": "t", "7": "t", "8": "b", "q": "g", "y": "v",
    "w": "vv", "d": "cl", "u": "ll", "n": "rl", "m": "rrl",
})
GO_ON = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
REFERENCE = re.compile(r"[^\W\d_]{2,}[0-9lIO]*[-/][-/0-9lIOSo]{2,}")
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
LEAD, TRAIL = "\"'[{<|“‘*", "\"')]}>|.,;:?!”’*"
WORDISH = re.compile(rf"(?=[{SIGNS}-]*[^\W\d_])(?:[^\W\d_]|[{SIGNS}-])+")


def folded(text: str) -> str:
    """Lower-case text in which look-alikes are equal."""
    return text.lower().translate(_ALIKE)


def number(text: str) -> int | None:
    """Value of a bare arabic or roman page number."""
    digits = re.match(r"\(?([0-9]+)", text)
    if digits:
        return int(digits[1])
    values = [ROMAN[c] for c in text]
    return sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0]))


def furniture(lines: list[str]) -> dict[int, str]:
    """``page_no`` or ``header`` by line index."""
    found: dict[int, str] = {}
    weak: list[tuple[int, int, bool]] = []
    marks = [i for i, x in enumerate(lines) if "\x0c" in x]
    for i, line in enumerate(lines):
        short = line.strip()
        if len(short) > MOST_PAGE_NUMBER and "  " in short:
            short = " ".join(short.split())
        if 0 < len(short) <= MOST_PAGE_NUMBER:
            low = short.lower()
            if STRONG.fullmatch(low):
                found[i] = "page_no"
            elif WEAK.fullmatch(low):
                weak.append((i, number(low), low[0].isdigit() or low[0] == "("))
    first = {(value, arabic): i for i, value, arabic in reversed(weak)}
    last = {(value, arabic): i for i, value, arabic in weak}
    for i, value, arabic in weak:
        if last.get((value + 1, arabic), i) > i + 2 or first.get((value - 1, arabic), i) < i - 2:
            found[i] = "page_no"
    seen: dict[str, list[int]] = defaultdict(list)
    part: set[int] = set()
    plain = Counter(x.strip() for x in lines if len(x) > 9)
    if not found and not marks and not any(n > 1 for n in plain.values()) and not any(PAGE_PART.search(x.lower()) for x in lines if len(x) > 12 and ("p" in x or "P" in x)):
        return found
    for i, line in enumerate(lines):
        short = " ".join(line.split()).lower()
        if i in found or len(short) < LEAST_HEADER:
            continue
        bare = PAGE_PART.sub("", line.lower()) if "p" in short else line.lower()
        if len(bare) != len(line):
            part.add(i)
        seen[folded(" ".join(bare.split()))].append(i)
    filled = [i for i, x in enumerate(lines) if x.strip()]
    place = {i: k for k, i in enumerate(filled)}
    edges = {i for i, kind in found.items() if kind == "page_no"}
    beside = set()
    for i in edges | set(marks):
        k = place[i] if i in place else None
        if k is not None:
            beside |= {filled[j] for j in (k - 1, k + 1) if 0 <= j < len(filled)}
    beside |= set(marks)
    opening = {folded(w) for line in [x for x in lines if x.strip()][:6] for w in GO_ON.findall(line)}
    for key, places in seen.items():
        if len(places) < 2 or sum(c.isalnum() for c in key) < LEAST_HEADER:
            continue
        line = " ".join(lines[places[0]].split())
        at_edge = sum(i in beside or i in part for i in places)
        words = GO_ON.findall(line)
        titled = len(words) > 3 and sum(folded(w) in opening for w in words) >= 0.6 * len(words)
        apart = not line[:1].islower() and line[-1:] not in ".,;:" and (REFERENCE.search(line) or titled or len(places) > 2)
        if at_edge >= 2 or apart:
            for i in places:
                found[i] = "header"
    headers = [i for i, kind in found.items() if kind == "header"]
    by_header = set()
    for i in headers:
        k = place[i]
        by_header |= {filled[j] for j in (k - 1, k + 1) if 0 <= j < len(filled)}
    for i, _, _ in weak:
        if i in by_header or any(abs(place[i] - place[m]) <= 1 for m in marks if m in place):
            found[i] = "page_no"
    return found


def broken_end(line: str) -> tuple[int, str] | None:
    """Place and left part of a word broken at the end of a line: letters, also with hyphens within, before a hyphen."""
    full = line.rstrip()
    end = len(full) - 1
    if end < 1 or full[end] not in HYPHENS or not full[end - 1].isalpha():
        return None
    start = end
    while start and (full[start - 1].isalpha() or full[start - 1] == "-" and full[start].isalpha()):
        start -= 1
    return (start, full[start:end]) if full[start] != "-" else (start + 1, full[start + 1 : end])


def breaks(lines: list[str], gone: dict[int, str]) -> list[tuple[int, str, str, int, int]]:
    """(line index, left part, right part, index of the line that may go on, its rank) of words broken at a line's end, in lower case."""
    found = []
    running = [i for i, line in enumerate(lines) if i not in gone and line.strip()]
    for k, i in enumerate(running):
        left = broken_end(lines[i])
        for rank, j in enumerate(running[k + 1 : k + 1 + GO_ON_LINES] if left else ()):
            right = GO_ON.match(lines[j].lstrip())
            if right:
                found.append((i, left[1].lower(), right[0].lower(), j, rank))
    return found


def forms(token: str) -> list[str]:
    """The words that a lower-case token may be: without the punctuation around it, and with a bracket that may be a c."""
    core = token.lstrip(LEAD).rstrip(TRAIL)
    if not core:
        return []
    if core[0] == "(":
        bare = core.lstrip("(" + LEAD)
        return [x for x in ([bare] if ")" in token else [bare, core]) if WORDISH.fullmatch(x)] if bare else []
    return [core] if WORDISH.fullmatch(core) else []


def running(text: str) -> tuple[str, list[str], dict[int, str], list]:
    """The running text without furniture and broken words, with the lines, the furniture and the breaks."""
    lines = text.split("\n")
    gone = furniture(lines)
    broken = breaks(lines, gone)
    if not gone and not broken:
        return text, lines, gone, broken
    kept = ["" if i in gone else x for i, x in enumerate(lines)]
    for i, left, right, j, rank in broken:
        if rank:
            continue
        end = broken_end(kept[i])
        kept[i] = kept[i][: end[0]] if end else kept[i]
        rest = kept[j].lstrip()
        kept[j] = rest[len(right):] if rest.lower().startswith(right) else kept[j]
    return "\n".join(kept), lines, gone, broken


COLUMNS = ["kind", "record_key", "line_no", "a", "b", "n"]
KINDS = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64()]
SHAPE = "kind string, record_key string, line_no int, a string, b string, n long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, KINDS)], COLUMNS)


def _examined(batches):
    """Furniture (f) and breaks (h) of each text, and this partition's word counts (w)."""
    count: Counter = Counter()
    words: Counter = Counter()

    def settle():
        for token, n in count.items():
            for word in forms(token):
                words[word] += n
        count.clear()

    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            body, _, gone, broken = running(text)
            count.update(body.lower().split())
            rows += [("f", key, i + 1, kind, None, None) for i, kind in gone.items()]
            rows += [("h", key, i + 1, left, right, rank) for i, left, right, _, rank in broken]
        if len(count) > 400_000:
            settle()
        yield _rows(rows)
    settle()
    words = list(words.items())
    for i in range(0, len(words), 20_000):
        yield _rows([("w", None, None, word, None, n) for word, n in words[i : i + 20_000]])


def bit(word: str) -> int:
    """Place of a word in the bitmap."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42) & (BITS - 1)


def _located(bits: np.ndarray):
    """Occurrences of the marked words in running text."""

    def run(batches):
        known: dict[str, list[str]] = {}
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = {}
                for token in set(text.lower().split()):
                    marked = known.get(token)
                    if marked is None:
                        marked = known[token] = [w for w in forms(token) if bits[(b := bit(w)) >> 3] >> (b & 7) & 1]
                    if marked:
                        hits[token] = marked
                if not hits:
                    continue
                _, lines, gone, broken = running(text)
                first = {j for _, _, _, j, rank in broken if not rank}
                for i, line in enumerate(lines):
                    if i in gone:
                        continue
                    tokens = line.lower().split()
                    for token in tokens[1 if i in first else 0 :]:
                        rows += [("c", key, i + 1, w, None, None) for w in hits.get(token, ())]
            if len(known) > 500_000:
                known.clear()
            yield _rows(rows)

    return run


def anagram(word: Column) -> Column:
    """Sum of the fifth powers of the character codes: equal for anagrams."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, x: (a + _fifth(F.ascii(x).cast("long") % CODES)) % WRAP)


def _fifth(c: Column) -> Column:
    return c * c * c * c * c


def _value(text: str) -> int:
    return sum((ord(c) % CODES) ** 5 for c in text) % WRAP


def _differences(words: DataFrame, *columns: str) -> DataFrame:
    """``id`` and ``columns`` of the words with a row for each one or two neighbouring characters ``taken`` away at ``at``: the hash
    that is left. The words themselves stay behind, so that a long one does not travel with each of its places."""
    chars = F.filter(F.split("word", ""), lambda x: x != "")
    one = F.transform("chars", lambda x, i: F.struct((i + 1).alias("at"), x.alias("taken")))
    two = F.transform(F.slice(F.col("chars"), F.lit(1), F.greatest(F.size("chars") - 1, F.lit(0))), lambda x, i: F.struct((i + 1).alias("at"), F.concat(x, F.get(F.col("chars"), i + 1)).alias("taken")))
    taken = words.select("id", "hash", *columns, chars.alias("chars")).select("id", "hash", *columns, F.explode(F.concat(one, two)).alias("x"))
    return taken.select("id", *columns, "x.at", "x.taken", F.pmod(F.col("hash") - anagram(F.col("x.taken")), F.lit(WRAP)).alias("left"))


def _ratio() -> Column:
    """How many times as frequent as its misreading a word must be."""
    return F.when(F.col("odd"), ODD_RATIO).otherwise(PLAIN_RATIO)


def vocabulary(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words of ``counts(word, n)`` that may be misread, and those that are frequent enough to be what was printed."""
    frequent = counts.where((F.col("n") >= LEAST_FREQUENT) & F.col("word").rlike(r"^\p{L}[\p{L}-]*\p{L}$")).select("word", F.col("n").alias("n_printed"))
    rare = counts.withColumn("odd", F.col("word").rlike(f"[{SIGNS}]")).where(F.col("odd") | (F.length("word") >= 3))
    return rare.withColumn("hash", anagram(F.col("word"))), frequent.withColumn("hash", anagram(F.col("word")))


def confusions(rare: DataFrame, frequent: DataFrame) -> dict[tuple[str, str], int]:
    """The confusions (as read, as printed) that enough of the corpus' words show, with the number of words."""
    rare, frequent = (materialise(x.withColumn("id", F.monotonically_increasing_id())) for x in (rare, frequent))
    read = _differences(rare, "n", "odd").withColumnsRenamed({"id": "read_id", "taken": "read"})
    right = _differences(frequent, "n_printed").withColumnsRenamed({"id": "print_id", "taken": "print"})
    # a word meets itself here too, and is left out as it is no more frequent than itself
    met = read.join(right, ["left", "at"]).where(F.col("n_printed") >= F.col("n") * _ratio())
    met = met.join(rare.select(F.col("id").alias("read_id"), "word"), "read_id").join(frequent.select(F.col("id").alias("print_id"), F.col("word").alias("printed")), "print_id")
    tail = lambda word, taken: F.substring(F.col(word), F.col("at") + F.length(taken), F.length(word))
    met = met.where((F.substring(F.col("word"), F.lit(1), F.col("at") - 1) == F.substring(F.col("printed"), F.lit(1), F.col("at") - 1)) & (tail("word", "read") == tail("printed", "print")))
    # one of the two is a single character that the other does not hold, else less would do
    met = met.where((F.least(F.length("read"), F.length("print")) == 1) & ~F.contains("read", "print") & ~F.contains("print", "read"))
    best = met.groupBy("word").agg(F.max(F.struct("n_printed", "printed", "read", "print")).alias("b")).select("word", "b.printed", "b.read", "b.print")
    best = materialise(best)
    sound = best.join(best.select(F.col("word").alias("printed")), "printed", "left_anti")
    support = sound.groupBy("read", "print").agg(F.countDistinct("printed").alias("words")).where(F.col("words") >= LEAST_SUPPORT)
    shown = {(r["read"], r["print"]): r["words"] for r in support.collect()}  # pairs of one and one or two characters
    return {pair: words for pair, words in sorted(shown.items()) if words >= LEAST_SUPPORT_SHARE * max(shown.values())}


def explained(word: str, printed: str, known: dict[str, list[tuple[str, str, int]]], most: int = 2) -> int:
    """How well ``word`` is explained as ``printed`` with one to ``most`` of the confusions ``known`` (by the first character read).

    The words that show the rarest confusion used, of the best way if there are several; 0 if there is none.
    """
    open_, best = [(0, 0, most, 1 << 30)], 0
    while open_:
        i, j, left, least = open_.pop()
        while True:
            if left:
                open_ += [(i + len(a), j + len(b), left - 1, min(least, n)) for a, b, n in known.get(word[i : i + 1], ()) if word.startswith(a, i) and printed.startswith(b, j)]
            if i < len(word) and j < len(printed) and word[i] == printed[j]:
                i, j = i + 1, j + 1
                continue
            break
        if i == len(word) and j == len(printed) and left < most:
            best = max(best, least)
    return best


def _agree(held: dict[tuple[str, str], int]):
    """The pairs that confusions explain, with the order of magnitude of the evidence."""

    def run(batches):
        known = defaultdict(list)
        for (a, b), n in held.items():
            known[a[0]].append((a, b, n))
        for batch in batches:
            support = np.array([explained(a, b, known) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], np.int64)
            digits = pa.array([len(str(n)) for n in support.tolist()], pa.int32())
            yield batch.append_column("support", digits).filter(pa.array(support > 0))

    return run


def corrections(counts: DataFrame, joined: DataFrame) -> DataFrame:
    """``(word, printed)``: the correction of each misread word of ``counts(word, n)`` and of the joined words ``joined(word)``."""
    every = counts.select("word", "n").unionAll(joined.select("word", F.lit(1).cast("long"))).groupBy("word").agg(F.max("n").alias("n"))
    rare, frequent = vocabulary(counts)
    frequent = materialise(frequent)
    held = confusions(rare, frequent)
    rare = vocabulary(every)[0]
    pairs = [(b, "", False, _value(a) - _value(b)) for a, b in held]
    pairs += [(b, d, True, _value(a) - _value(b) + _value(c) - _value(d)) for k, (a, b) in enumerate(held) for c, d in [*held][k:] if (a, b) != (d, c)]
    kind = "array<struct<one: string, two: string, twice: boolean, difference: bigint>>"
    fixed = F.array(*[F.struct(F.lit(a).alias("one"), F.lit(b).alias("two"), F.lit(twice).alias("twice"), F.lit(d).cast("long").alias("difference")) for a, b, twice, d in pairs]).cast(kind)
    likely = frequent.select(F.col("word").alias("printed"), "n_printed", "hash", F.explode(F.filter(fixed, lambda x: F.contains("word", x["one"]) & F.contains("word", x["two"]))).alias("x"))
    likely = likely.select("printed", "n_printed", F.pmod(F.col("hash") + F.col("x.difference"), F.lit(WRAP)).alias("hash"), F.col("x.twice").alias("twice"))
    met = rare.join(likely, "hash").where((F.col("word") != F.col("printed")) & (F.col("n_printed") >= F.col("n") * _ratio()))
    met = met.select("word", "printed", "n_printed", "twice", "n").mapInArrow(_agree(held), "word string, printed string, n_printed long, twice boolean, n long, support int")
    # a bracket before a frequent word is a bracket
    bare = counts.select(F.concat(F.lit("("), "word").alias("word"), F.col("n").alias("n_bare"))
    met = met.join(bare, "word", "left").where(F.coalesce("n_bare", F.lit(0)) * 5 <= F.greatest(F.col("n") * 6, F.col("n_printed") / 10))
    best = F.max(F.struct((~F.col("twice")).alias("once"), "support", "n_printed", "printed"))
    return met.groupBy("word").agg(best.alias("b")).select("word", F.col("b.printed").alias("printed"))


def defects(texts: DataFrame) -> DataFrame:
    """``(record_key, line_no, defect, repaired, read)`` of ``texts(record_key, text)``; ``read`` is the word as it stands in the text, without a break."""
    texts = texts.where(F.col("record_key").isNotNull() & (F.length("text") > 0)).select("record_key", "text")
    seen = materialise(texts.mapInArrow(_examined, SHAPE))
    counts = materialise(seen.where("kind = 'w'").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n")))
    lines = seen.where("kind = 'f'").select("record_key", "line_no", F.col("a").alias("defect"), F.lit("").alias("repaired"), F.lit("").alias("read"))
    broken = seen.where("kind = 'h'").select("record_key", "line_no", F.concat("a", "b").alias("joined"), F.concat_ws("-", "a", "b").alias("kept"), F.col("n").alias("rank")).distinct()
    fixes = materialise(corrections(counts, broken.select(F.col("joined").alias("word")).unionAll(broken.select("kept")).distinct()))

    # hyphen evidence: the first line to go on with whose word the corpus holds, in the form that it holds more often
    tried = broken.select("joined", "kept").distinct()
    for name in ("joined", "kept"):
        tried = tried.join(fixes.toDF(name, f"{name}_fix"), name, "left").withColumn(f"{name}_form", F.coalesce(f"{name}_fix", name))
        tried = tried.join(counts.toDF(f"{name}_form", f"n_{name}"), f"{name}_form", "left")
    n_kept, n_joined = F.coalesce("n_kept", F.lit(0)), F.coalesce("n_joined", F.lit(0))
    tried = tried.select("joined", "kept", F.when(n_kept > n_joined, F.col("kept_form")).otherwise(F.col("joined_form")).alias("whole"), (F.greatest(n_kept, n_joined) >= 2).alias("known"))
    words = broken.join(tried, ["joined", "kept"]).groupBy("record_key", "line_no").agg(F.max(F.struct("known", (-F.col("rank")).alias("rank"), "whole", "joined")).alias("w"))
    words = words.select("record_key", "line_no", F.lit("hyphen").alias("defect"), F.col("w.whole").alias("repaired"), F.col("w.joined").alias("read"))

    # the marks of words to correct, in a bitmap of fixed size
    marks = fixes.select(F.expr(f"xxhash64(word) & {BITS - 1}").alias("place"))
    marks = marks.select(F.expr("cast(place div 32 as int)").alias("at"), F.expr("shiftleft(1L, cast(place % 32 as int))").alias("mark"))
    bits = np.zeros(BITS // 32, np.uint32)
    # at most BITS / 32 rows; an iterator would be read after its shuffle files are deleted
    for row in marks.groupBy("at").agg(F.bit_or("mark").alias("mark")).collect():
        bits[row["at"]] = row["mark"]
    at = texts.mapInArrow(_located(bits.view(np.uint8)), SHAPE).select("record_key", "line_no", F.col("a").alias("word"))
    misread = at.join(fixes, "word").select("record_key", "line_no", F.lit("char").alias("defect"), F.col("printed").alias("repaired"), F.col("word").alias("read"))
    return lines.unionByName(words).unionByName(misread).distinct()


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    first = table(spark, folder, "docling_outputs").select(F.col("document_id").alias("record_key"), "text")
    return first.unionAll(table(spark, folder, "company_profile_outputs").select("file_hash", "text"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every defect of every text."""
    return defects(_texts(spark, folder)).select("record_key", "line_no", "defect", "repaired").distinct()


def repaired(text: str, found: list) -> str:
    """A text as continuous paragraphs, with its defects mended."""
    lines = text.split("\n")
    gone = {d["line_no"] - 1 for d in found if d["defect"] in ("header", "page_no")}
    whole = {d["line_no"] - 1: d["repaired"] for d in found if d["defect"] == "hyphen"}
    joined = {d["line_no"] - 1: d["read"] for d in found if d["defect"] == "hyphen"}
    right: dict[int, dict[str, str]] = defaultdict(dict)
    for d in found:
        if d["defect"] == "char":
            right[d["line_no"] - 1][d["read"]] = d["repaired"]
    skip = {}
    for i, left, part, j, _ in reversed(breaks(lines, {i: "" for i in gone})):
        if left + part == joined.get(i):
            skip[j] = len(part)
    paragraphs, now = [], []
    for i, line in enumerate(lines):
        if i in gone:
            continue
        line = line.strip()
        if i in skip:
            line = line[skip[i] :].lstrip() if line[skip[i] : skip[i] + 1].isspace() else line[skip[i] :]
        tokens = line.split()
        for k, token in enumerate(tokens):
            for word in forms(token.lower()) if right.get(i) else ():
                printed = right[i].get(word)
                if printed:
                    at = token.lower().find(word)
                    cased = printed.upper() if token.isupper() and len(printed) > 1 else printed.capitalize() if token[at : at + 1].isupper() else printed
                    tokens[k] = token[:at] + cased + token[at + len(word) :]
        line = " ".join(tokens)
        if i in whole:
            before = broken_end(line)
            left = before[1] if before else ""
            cased = whole[i].upper() if left.isupper() and len(left) > 1 else whole[i][:1].upper() + whole[i][1:] if left[:1].isupper() else whole[i]
            line = (line[: before[0]] if before else line + " ") + cased
        if not line:
            if now and i not in skip:
                paragraphs.append(" ".join(now))
                now = []
        elif i in skip and now and line[0] in ".,;:!?)":
            now[-1] += line
        else:
            now.append(line)
    return "\n\n".join([*paragraphs, " ".join(now)] if now else paragraphs)


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as continuous paragraphs without the defects."""
    texts = _texts(spark, folder).where(F.col("record_key").isNotNull()).dropDuplicates(["record_key"])
    found = defects(texts).groupBy("record_key").agg(F.sort_array(F.collect_set(F.struct("line_no", "defect", "repaired", "read"))).alias("found"))

    def run(batches):
        for batch in batches:
            done = [None if text is None else repaired(text, found or []) for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], ["record_key", "text"])

    return texts.join(found, "record_key", "left").select("record_key", "text", "found").mapInArrow(run, "record_key string, text string")


QUERIES = {"p4_found": p4_found, "p4_repaired": p4_repaired}
