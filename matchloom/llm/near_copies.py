"""Problem 1: near copies of texts in a collection too large for comparing all pairs.

Method: 128 universal hash minima of each text's set of three-word shingles, cut into 32 bands of 4. Texts that agree in a
band are candidates; candidates are checked against the whole signature (one byte a minimum) and then exactly. Groups are
the connected components of the links, found by alternating large-star and small-star. A pair at similarity 0.7 agrees in
no band with probability 0.0002.

Texts with equal shingle sets form a class whose least key stands for it, so that copies never meet in a band. A bucket
above ``BLOCK`` members is cut into blocks that meet pairwise in different tasks; of the pairs of a block only those leave
it whose brief signatures allow the threshold. The exact check compares sets of 32-bit shingle hashes, made once for each
text that has a candidate; two different shingles of a pair of texts of a thousand words collide with probability 0.0002. Within a class, exact copies of a text
form a group of copies. Pairs of different texts are written out in full, those of a class in blocks. More than
``SPELLED`` exact copies of one text are each linked to the least key of the copies, which carries their links to other
texts; up to that number every copy carries them.

Defined cases: null, empty and short texts (under ``least_words`` words) have no links; repeated rows of a key count once;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.components import components
from matchloom.llm.shingles import Words, minima, permutations, shingles
from matchloom.session import discard, materialise, table

WIDTH, LEAST_WORDS, THRESHOLD = 3, 20, 0.7
BANDS, ROWS = 32, 4
BLOCK, SPELLED = 1_024, 64
#: Minima of the first, coarse look at a candidate's signatures; most candidates need no more.
BRIEF = 32
#: Standard deviations of the signature's estimate below the threshold at which a candidate is dropped.
SLACK = 4.5


def _signer(width: int, least_words: int):
    a, b = permutations(BANDS * ROWS)
    weights = np.random.default_rng(2).integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
    salts = np.random.default_rng(3).integers(0, 2**63, BANDS, dtype=np.uint64)

    def run(batches):
        words = Words()
        for batch in batches:
            keys, classes, exact, signs, bands = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = shingles(text, width, least_words, words)
                if values is None:
                    continue
                best = minima(values, a, b)
                band = ((best.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * weights).sum(axis=1, dtype=np.uint64) + salts
                band ^= band >> np.uint64(31)
                band *= np.uint64(0x9E3779B97F4A7C15)
                keys.append(key)
                classes.append(xxhash.xxh3_128_digest(values.tobytes()))
                exact.append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
                signs.append((best >> np.uint32(11)).astype(np.uint8).tobytes())
                bands.append(band.view(np.int64))
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(classes, pa.binary()), pa.array(exact, pa.binary()), pa.array(signs, pa.binary()), lists], ["key", "same", "exact", "sign", "bands"])

    return run


def signatures(texts: DataFrame, width: int = WIDTH, least_words: int = LEAST_WORDS) -> DataFrame:
    """``texts(key, text)`` as ``(id, key, same, exact, sign, bands)``; one row for each row with enough words."""
    signed = texts.select("key", "text").where("key is not null and text is not null").mapInArrow(_signer(width, least_words), "key string, same binary, exact binary, sign binary, bands array<long>")
    return signed.withColumn("id", F.monotonically_increasing_id())


def _block_pairs(bar: float):
    """Pairs of a bucket's block, or of two blocks, whose brief signatures agree in enough minima; the rows come in order of band and blocks."""

    def met(rows: pa.Table) -> pa.RecordBatch:
        same = np.ones(max(0, rows.num_rows - 1), bool)
        for name in ("band", "i", "j"):
            column = rows[name].to_numpy()
            same &= column[1:] == column[:-1]
        run = np.r_[0, np.cumsum(~same)][: rows.num_rows]
        own, cross, ids = rows["own"].to_numpy(), rows["i"].to_numpy() != rows["j"].to_numpy(), rows["id"].to_numpy()
        group = rows["group"].to_numpy() if not rows["group"].null_count else ids
        sign = np.frombuffer(b"".join(rows["sign"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        lo, hi = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = np.arange(rows.num_rows)
        for step in range(1, rows.num_rows):
            at = at[at + step < rows.num_rows]
            at = at[run[at] == run[at + step]]
            if not len(at):
                break
            for part in np.array_split(at, -(-len(at) // 65_536)):
                part = part[(~cross[part] | (own[part] != own[part + step])) & (group[part] != group[part + step])]
                near = part[(sign[part] == sign[part + step]).sum(axis=1) >= bar]
                lo.append(np.minimum(ids[near], ids[near + step]))
                hi.append(np.maximum(ids[near], ids[near + step]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(lo)), pa.array(np.concatenate(hi))], ["lo", "hi"])

    def run(batches):
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
            # the last block may go on in the next batch; a block has a bounded size
            last = rows.num_rows and int(np.argmax(np.logical_and.reduce([rows[x].to_numpy() == rows[x][-1].as_py() for x in ("band", "i", "j")])))
            yield met(rows.slice(0, last))
            rest = rows.slice(last)
        if rest is not None:
            yield met(rest)

    return run


def candidates(first: DataFrame, threshold: float, marks: DataFrame | None = None) -> DataFrame:
    """``(lo, hi)`` of the rows of ``first(id, sign, bands)`` that share a band and whose brief signatures may reach the threshold, each pair once.

    With ``marks(id, group)`` only pairs from different groups; a row without a mark is a group of its own.
    """
    bands = first.select("id", F.explode("bands").alias("band"))
    bands = bands.withColumn("group", F.lit(None).cast("long")) if marks is None else bands.join(marks, "id", "left").withColumn("group", F.coalesce("group", "id"))
    sizes = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("group").alias("least"), F.max("group").alias("most"))
    sizes = sizes.where("n > 1" if marks is None else "n > 1 and least <> most").select("band", "n")
    members = bands.join(sizes, "band").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = members.join(first.select("id", F.substring("sign", 1, BRIEF).alias("sign")), "id")
    members = members.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "group", "sign")
    bar = BRIEF * (1 / 256 + (1 - 1 / 256) * (threshold - SLACK * (threshold * (1 - threshold) / BRIEF) ** 0.5))
    ordered = members.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return ordered.mapInArrow(_block_pairs(bar), "lo long, hi long").distinct()


def _estimate(batches):
    for batch in batches:
        n = batch.num_rows
        flat = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(n, -1) if n else np.zeros((0, 1), np.uint8) for k in (2, 3)]
        share = (flat[0] == flat[1]).mean(axis=1) if n else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((share - 1 / 256) / (1 - 1 / 256), pa.float64())], ["lo", "hi", "estimate"])


def estimated(pairs: DataFrame, first: DataFrame, threshold: float) -> DataFrame:
    """The pairs that may reach the threshold by their whole signatures."""
    sign = first.select("id", "sign")
    met = pairs.join(sign.toDF("lo", "sign_lo"), "lo").join(sign.toDF("hi", "sign_hi"), "hi").select("lo", "hi", "sign_lo", "sign_hi")
    least = threshold - SLACK * (threshold * (1 - threshold) / (BANDS * ROWS)) ** 0.5
    return met.mapInArrow(_estimate, "lo long, hi long, estimate double").where(F.col("estimate") >= least).select("lo", "hi")


def _sets(width: int, least_words: int):
    def run(batches):
        words = Words()
        for batch in batches:
            found = [shingles(x, width, least_words, words) for x in batch.column(2).to_pylist()]
            found = [None if x is None or xxhash.xxh3_128_digest(x.tobytes()) != same else x.tobytes() for x, same in zip(found, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "values"])

    return run


def _jaccard(batches):
    for batch in batches:
        found = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            found.append(common / (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["lo", "hi", "similarity"])


@dataclass
class Classes:
    """Texts by the set of their shingles: ``first(id, sign, bands)`` and ``named(id, same, root)`` hold one row a class, whose
    least key is ``root``; ``membership(key, root, copy)`` the keys of classes of several; ``copy`` is the least key of the same text."""

    first: DataFrame
    named: DataFrame
    membership: DataFrame


def classes(texts: DataFrame, width: int, least_words: int) -> Classes:
    """The classes of ``texts(key, text)``. Of repeated rows of a key the least counts; only narrow rows are grouped."""
    signed = materialise(signatures(texts, width, least_words))
    names = materialise(signed.groupBy("key").agg(F.min(F.struct("same", "exact", "id")).alias("s")).select("key", "s.*"))
    named = names.groupBy("same").agg(F.min(F.struct("key", "id")).alias("r"), F.count("*").alias("n"))
    named = materialise(named.select("same", F.col("r.key").alias("root"), F.col("r.id").alias("id"), "n"))
    within = names.select("key", "same", "exact").join(named.where("n > 1").select("same", "root"), "same")
    least = within.groupBy("same", "exact").agg(F.min("key").alias("copy"))
    membership = materialise(within.join(least, ["same", "exact"]).select("key", "root", "copy"))
    first = materialise(signed.select("id", "sign", "bands").join(named.select("id"), "id", "left_semi"))
    discard(signed, names)
    return Classes(first, named.select("id", "same", "root"), membership)


def verified(met: DataFrame, found: Classes, texts: DataFrame, threshold: float, width: int, least_words: int) -> DataFrame:
    """``(lo, hi, similarity)`` of the pairs ``met(lo, hi)`` that reach the threshold: by their signatures, then by their sets, made once for each text."""
    pairs = materialise(estimated(met, found.first, threshold))
    ends = pairs.select(F.col("lo").alias("id")).unionAll(pairs.select("hi")).distinct()
    wanted = found.named.join(ends, "id", "left_semi").select("id", "same", F.col("root").alias("key"))
    # a key may stand in several rows; the text that counts is the one of its class
    held = texts.where("text is not null").select("key", "text").join(wanted, "key").select("id", "same", "text").mapInArrow(_sets(width, least_words), "id long, values binary")
    held = materialise(held.where("values is not null").dropDuplicates(["id"]))
    both = pairs.join(held.toDF("lo", "x"), "lo").join(held.toDF("hi", "y"), "hi").select("lo", "hi", "x", "y")
    links = both.mapInArrow(_jaccard, "lo long, hi long, similarity double").where(F.col("similarity") >= threshold - 1e-12)
    links = materialise(links)
    discard(pairs, held)
    return links


def similar(texts: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Links ``(lo, hi, similarity)`` between class representatives of ``texts(key, text)``, and the membership ``(key, root, copy)``."""
    found = classes(texts, width, least_words)
    met = materialise(candidates(found.first, threshold))
    links = verified(met, found, texts, threshold, width, least_words)
    roots = found.named.select("id", "root")
    named = links.join(roots.toDF("lo", "a"), "lo").join(roots.toDF("hi", "b"), "hi")
    named = materialise(named.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "similarity"))
    discard(links, met, found.first)
    return named, found.membership


def grouped(texts: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(key, root)`` of the keys in a group of near copies, without a list of its pairs.

    First each member of a bucket is checked against the bucket's least only. Then, in buckets whose members do not all stand
    in one group yet, the pairs from different groups are. A pair that is not checked stands in one group anyway, so that the
    groups are those of all pairs; many texts that are all alike cost one check for each bucket they share.
    """
    found = classes(texts, width, least_words)
    bands = found.first.select("id", F.explode("bands").alias("band"))
    heads = bands.groupBy("band").agg(F.min("id").alias("lo"), F.count("*").alias("n")).where("n > 1")
    stars = materialise(bands.join(heads, "band").where("id <> lo").select("lo", F.col("id").alias("hi")).distinct())
    links = verified(stars, found, texts, threshold, width, least_words)
    marks = materialise(components(links.select("lo", "hi")).toDF("id", "group"))
    rest = materialise(candidates(found.first, threshold, marks))
    more = verified(rest, found, texts, threshold, width, least_words)
    roots = found.named.select("id", "root")
    named = links.unionAll(more).join(roots.toDF("lo", "a"), "lo").join(roots.toDF("hi", "b"), "hi").select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    copies = found.membership.where("key <> root").select(F.col("root").alias("lo"), F.col("key").alias("hi"))
    groups = components(named.unionAll(copies)).toDF("key", "root")
    discard(stars, rest, found.first)
    return groups


def spelled(links: DataFrame, membership: DataFrame) -> DataFrame:
    """Pairs of keys from links between representatives and the membership of classes.

    ``membership(key, root, copy)`` tells the copies of a text apart within a class; without ``copy`` a class is one text.
    """
    if "copy" not in membership.columns:
        membership = membership.withColumn("copy", F.col("root"))
    sizes = membership.groupBy("root", "copy").agg(F.count("*").alias("n"))
    counted = membership.join(sizes, ["root", "copy"])
    stars = counted.where((F.col("n") > SPELLED) & (F.col("key") != F.col("copy"))).select(F.col("copy").alias("lo"), F.col("key").alias("hi"))
    # the members that carry links: every key, or the least key of many copies
    carriers = counted.where((F.col("n") <= SPELLED) | (F.col("key") == F.col("copy"))).select("root", "key")
    blocks = carriers.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    spread = carriers.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a key of block i meets those of block j; a block meets itself once
    x = spread.select("root", F.col("own").alias("i"), F.col("other").alias("j"), F.col("key").alias("a"))
    y = spread.select("root", F.col("other").alias("i"), F.col("own").alias("j"), F.col("key").alias("b"))
    within = x.join(y, ["root", "i", "j"]).where("a < b").select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    left = links.select("lo", "hi").join(carriers.select(F.col("root").alias("lo"), F.col("key").alias("a")), "lo", "left")
    both = left.join(carriers.select(F.col("root").alias("hi"), F.col("key").alias("b")), "hi", "left").select(F.coalesce("a", "lo").alias("a"), F.coalesce("b", "hi").alias("b"))
    return stars.unionAll(within).unionAll(both.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "docling_outputs").select(F.col("document_id").alias("key"), "text")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents with nearly the same text."""
    return spelled(*similar(_texts(spark, folder))).toDF("doc_lo", "doc_hi")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document in a group of near copies, with the group's least key."""
    return grouped(_texts(spark, folder)).toDF("document_id", "group_id")


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}
#: Pairs by the prefix filter: of two sets that similar, the rarest shingles must meet.
_PAIRS = f"""docs AS (SELECT DISTINCT document_id, text FROM docling_outputs WHERE document_id IS NOT NULL AND text IS NOT NULL),
words AS (SELECT document_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS w FROM docs),
sets AS (SELECT document_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM words WHERE len(w) >= {LEAST_WORDS}),
flat AS (SELECT document_id, unnest(s) AS h, len(s) AS n FROM sets),
often AS (SELECT h, count(*) AS f FROM flat GROUP BY h),
ranked AS (SELECT document_id, h, n, row_number() OVER (PARTITION BY document_id ORDER BY f, h) AS k FROM flat JOIN often USING (h)),
rare AS (SELECT * FROM ranked WHERE k <= n - ceil({THRESHOLD} * n) + 1),
met AS (SELECT DISTINCT a.document_id AS x, b.document_id AS y FROM rare a JOIN rare b USING (h) WHERE a.document_id < b.document_id AND least(a.n, b.n) >= {THRESHOLD} * greatest(a.n, b.n) - 1e-9),
both_ AS (SELECT x, y, len(a.s) + len(b.s) AS total, len(list_intersect(a.s, b.s)) AS common FROM met JOIN sets a ON a.document_id = x JOIN sets b ON b.document_id = y),
pairs AS (SELECT x, y FROM both_ WHERE common / (total - common) >= {THRESHOLD} - 1e-12)"""
ORACLE = {
    "p1_found": f"WITH {_PAIRS} SELECT x AS doc_lo, y AS doc_hi FROM pairs",
    "p1_groups": f"WITH RECURSIVE {_PAIRS}, arcs AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs), reached(id, other) AS (SELECT DISTINCT x, x FROM arcs UNION SELECT r.id, a.y FROM reached r JOIN arcs a ON a.x = r.other) SELECT id AS document_id, min(other) AS group_id FROM reached GROUP BY id",
}
