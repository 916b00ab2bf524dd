"""Problem 5: cut items above a size limit into overlapping pieces that end at natural boundaries.

Method: the ends of an item's tokens (runs without white space, each with the white space behind it) are the prefix sums
of the token lengths. The ends that also close a sentence, line or paragraph form sorted sub-arrays. For each piece a
binary search finds the last boundary within the limit, the next piece starts ``overlap`` characters before it, and where
no boundary lies ahead the piece is cut hard at the limit.

Defined cases: a null or empty item and an item within the limit give no pieces; repeated rows of one key count once;
lengths are Unicode characters; extra columns are ignored, also where their names clash with the result's.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import table

LIMIT, OVERLAP = 4_000, 200
#: A stronger boundary is taken over a later weaker one if the piece stays at least this full.
LEAST_FULL = 0.5
TOKEN = re.compile(r"\S+\s*")
CLOSES_SENTENCE = re.compile(r"[.!?;:]['\")\]]*\s+\Z")
PIECES = "document_id string, field_name string, item_pos int, piece_no int, start_pos int, end_pos int, cut string, longest_run int, piece string"


def boundaries(text: str) -> tuple[dict[str, list[int]], int]:
    """Sorted boundary offsets by strength, and the longest run without white space."""
    lead = len(text) - len(text.lstrip())
    tokens = TOKEN.findall(text)
    ends = (np.cumsum([len(x) for x in tokens]) + lead).tolist()
    found: dict[str, list[int]] = {"paragraph": [], "line": [], "sentence": [], "word": []}
    longest = 0
    for token, end in zip(tokens, ends):
        run = len(token.rstrip())
        longest = max(longest, run)
        if run == len(token):
            continue
        space = token[run:]
        found["word"].append(end)
        if "\n" in space:
            found["line"].append(end)
            if space.count("\n") > 1:
                found["paragraph"].append(end)
        if CLOSES_SENTENCE.search(token):
            found["sentence"].append(end)
    if lead:
        found["word"].insert(0, lead)
    return found, longest


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, str]], int]:
    """(start, end, kind of boundary) of each piece, and the longest run; no pieces if the text is within the limit."""
    if limit <= overlap or overlap < 0:
        raise ValueError("the limit must be above the overlap, and the overlap not negative")
    if len(text) <= limit:
        return [], 0
    found, longest = boundaries(text)
    pieces, start, done = [], 0, 0
    while True:
        last = start + limit
        if last >= len(text):
            pieces.append((start, len(text), "end"))
            return pieces, longest
        for kind, offsets in found.items():
            k = bisect_right(offsets, last) - 1
            least = done if kind == "word" else max(done, start + int(limit * LEAST_FULL))
            if k >= 0 and offsets[k] > least:
                done = offsets[k]
                break
        else:
            done, kind = last, "hard"
        pieces.append((start, done, kind))
        start = done - overlap


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``items(document_id, field_name, item_pos, item)`` as pieces; an item that stands in several rows is cut in each."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]

    def run(batches):
        for batch in batches:
            for ids, fields, places, texts in [[c.to_pylist() for c in batch.columns]]:
                rows = []
                for document, field, place, text in zip(ids, fields, places, texts):
                    pieces, longest = cut(text, limit, overlap)
                    rows += [(document, field, place, n, a, b, kind, longest, text[a:b]) for n, (a, b, kind) in enumerate(pieces)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    return items.where(F.length("item") > limit).select("document_id", "field_name", "item_pos", "item").mapInArrow(run, PIECES)


def oversized(outputs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The texts and table elements of ``outputs`` above ``limit`` characters, filtered before anything leaves the JVM."""
    texts = outputs.where(F.length("text") > limit).select("document_id", F.lit("text").alias("field_name"), F.lit(0).alias("item_pos"), F.col("text").alias("item"))
    tables = (
        outputs.where(F.exists("tables", lambda x: F.length(x) > limit))
        .select("document_id", F.posexplode("tables").alias("item_pos", "item"))
        .select("document_id", F.lit("tables").alias("field_name"), "item_pos", "item")
    )
    return texts.unionByName(tables.where(F.length("item") > limit)).where(F.col("document_id").isNotNull())


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every oversized item."""
    return split_items(oversized(table(spark, folder, "docling_outputs"))).dropDuplicates(["document_id", "field_name", "item_pos", "piece_no"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The oversized items, with 1 where a run without white space forces a hard cut."""
    items = split_items(oversized(table(spark, folder, "docling_outputs"))).where(F.col("piece_no") == 0)
    return items.select("document_id", "field_name", "item_pos", (F.col("longest_run") > LIMIT).cast("int").alias("hard_cut")).distinct()


SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}
ORACLE = {
    "p5_found": f"""
WITH items AS (
  SELECT document_id, 'text' AS field_name, 0 AS item_pos, text AS item FROM docling_outputs
  UNION ALL
  SELECT document_id, 'tables', i - 1, tables[i] FROM (SELECT document_id, tables, unnest(range(1, len(tables) + 1)) AS i FROM docling_outputs)
)
SELECT DISTINCT document_id, field_name, CAST(item_pos AS INTEGER) AS item_pos,
  CAST(list_max(list_transform(string_split_regex(item, '{SPACE}'), lambda x: length(x))) > {LIMIT} AS INTEGER) AS hard_cut
FROM items WHERE length(item) > {LIMIT} AND document_id IS NOT NULL
"""
}
