"""Problem 9: passages that stand verbatim in more than one document.

Method: the tokens of a text are its runs of ``GRAM`` characters, one from each position; a passage of ``LEAST`` characters
is a run of ``LEAST - GRAM + 1`` tokens. The Cartesian tree over the tokens' hashes is cut at subtrees of that length, and
each node left is a compact window (left, centre, right): every run within it that holds the centre has the centre's hash
as its minimum. Two texts that share a long enough passage therefore have windows with equal hashes around it, whose
extents overlap by at least the passage: one hash function finds every shared passage, further ones would add nothing for
verbatim spans. Windows are joined by hash and by the overlap of their extents, and each match is verified on the texts,
from the centre outwards.

Equal grams at a fixed distance of at most ``GRAM`` (dot leaders, rules, repeated patterns) are one window, a run, so that a
periodic text has few windows. Two runs are matched by sliding the shorter along the longer in steps of its own length, from
the first to the last place: the spans found so cover whatever the two have in common, though not each of the many ways in
which it can be laid over itself.

Texts with equal content form a class whose least key stands for it. A hash above ``BLOCK`` windows is cut into blocks that
meet pairwise in different tasks. Pairs within a class are written out in full up to ``SPELLED`` members; in a larger one
each member is paired with the representative.

Defined cases: null, empty and short texts share nothing; a passage repeated within one document alone is no case; repeated
rows of a key count once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.near_copies import spelled
from matchloom.session import discard, materialise, stored, table

LEAST, GRAM = 240, 120
BLOCK = 256
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


def codes(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Powers:
    """Powers of the rolling hash's base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BACK, np.uint64)])
        return self.up[:n], self.down[:n]


def gram_hashes(points: np.ndarray, gram: int, powers: Powers) -> np.ndarray:
    """Hash of the ``gram`` characters from each position, alike wherever they stand."""
    up, down = powers.to(len(points) + 1)
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points + np.uint64(0x10001)) * up[:-1], out=sums[1:])
    value = (sums[gram:] - sums[:-gram]) * down[: len(points) - gram + 1]
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    return value


def tied(hashes: np.ndarray, least: int):
    """(left, centres, right) of the Cartesian tree's subtrees with at least ``least`` tokens; equal minima are centres of one.

    ``centres`` is one position, or an array where the minimum stands several times.
    """
    order = np.sort(hashes)
    repeated = set(order[1:][order[1:] == order[:-1]].tolist())
    open_ = [(0, len(hashes))]
    while open_:
        left, end = open_.pop()
        if end - left < least:
            continue
        centre = left + int(hashes[left:end].argmin())
        if repeated and int(hashes[centre]) in repeated:
            centres = left + np.flatnonzero(hashes[left:end] == hashes[centre])
            yield left, centres, end - 1
            starts, ends = np.r_[left, centres + 1], np.r_[centres, end]
            room = ends - starts >= least
            open_ += zip(starts[room].tolist(), ends[room].tolist())
        else:
            yield left, centre, end - 1
            open_.append((left, centre))
            open_.append((centre + 1, end))


def windows(hashes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(left, centre, right) of every window, the centres of a run one by one."""
    return [(left, int(c), right) for left, centres, right in tied(hashes, least) for c in np.atleast_1d(centres)]


def runs(centres: np.ndarray | int, most_step: int) -> list[tuple[int, int, int]]:
    """(first, count, step) of the stretches of rising positions at one distance of at most ``most_step``."""
    if isinstance(centres, int) or len(centres) == 1:
        return [(int(np.atleast_1d(centres)[0]), 1, 0)]
    steps = np.diff(centres)
    cut = np.flatnonzero(np.r_[True, (steps[1:] != steps[:-1]) | (steps[1:] > most_step)])
    found, used = [], 0
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(steps)]):
        # positions a to b stand at one distance; the first may belong to the stretch before
        first = max(a, used)
        if steps[a] <= most_step and b - first >= 1:
            found.append((int(centres[first]), b - first + 1, int(steps[a])))
            used = b + 1
        else:
            found += [(int(centres[k]), 1, 0) for k in range(first, b)]
            used = max(used, b)
    found += [(int(centres[k]), 1, 0) for k in range(used, len(centres))]
    return found


def _windows(least: int, gram: int):
    def run(batches):
        powers, span = Powers(), least - gram + 1
        for batch in batches:
            hashes, keys, rows = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(text) < least:
                    continue
                value = gram_hashes(codes(text), gram, powers)
                found = []
                for left, centres, right in tied(value, span):
                    if isinstance(centres, int):
                        found.append((left, centres, 1, 0, right))
                    else:
                        found += [(left, *x, right) for x in runs(centres, gram)]
                rows += found
                keys += [key] * len(found)
                hashes.append(value[[x[1] for x in found]])
            left, first, count, step, right = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            # extents, the widest of a run, count up to the passage's length only, and travel in one number with the centre
            place = (first * (span + 1) + np.minimum(first + (count - 1) * step - left, span)) * (span + 1) + np.minimum(right - first, span)
            columns = [pa.array(np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, np.int64)), pa.array(keys, pa.int64()), pa.array(place), pa.array(count * (gram + 1) + step)]
            yield pa.RecordBatch.from_arrays(columns, ["hash", "key", "place", "run"])

    return run


def classes(batches):
    """Key and content digest of each text."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in batch.column(1).to_pylist()], pa.binary())], ["key", "same"])


def _packed(batches):
    """Texts deflated, as they travel."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.compress(x.encode("utf-8", "surrogatepass"), 1) for x in batch.column(1).to_pylist()], pa.binary())], ["key", "text"])


def _joined(found: DataFrame, copies: DataFrame, least_tokens: int, gram: int) -> DataFrame:
    """Pairs of windows of different documents, other than ``copies(key)``, with equal hash whose extents overlap by enough tokens."""
    sizes = found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    members = found.join(sizes, "hash").join(copies, "key", "left_anti").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    base = F.lit(least_tokens + 1).cast("long")
    members = members.withColumns({"after": F.col("place") % base, "before": F.expr(f"place div {least_tokens + 1} % {least_tokens + 1}"), "centre": F.expr(f"cast(place div {(least_tokens + 1) ** 2} as int)")})
    members = members.withColumn("own", F.pmod(F.xxhash64("key", "centre"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.withColumns({"count": F.expr(f"cast(run div {gram + 1} as int)"), "step": F.expr(f"cast(run % {gram + 1} as int)")})
    window = F.struct("key", "centre", "before", "after", "own", "count", "step")
    # by block, not only by hash, so that the blocks of a hot hash meet in different tasks
    members = members.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).repartition("hash", "i", "j")
    met = members.groupBy("hash", "i", "j").agg(F.sort_array(F.collect_list(window)).alias("them")).where(F.size("them") > 1)
    met = met.select("i", "j", "them", F.posexplode("them").alias("at", "x")).select("i", "j", "x", F.explode(F.slice("them", F.col("at") + 2, F.size("them"))).alias("y"))
    overlap = F.least("x.before", "y.before") + F.least("x.after", "y.after") + 1
    met = met.where((F.col("x.key") != F.col("y.key")) & (overlap >= least_tokens) & ((F.col("i") == F.col("j")) | (F.col("x.own") != F.col("y.own"))))
    single = F.array(F.struct(F.col("x.centre").alias("at_lo"), F.col("y.centre").alias("at_hi")))
    # a run slides along the longer one in steps of its own length, and along one of another step from place to place
    slides = F.expr("""
      transform(array_distinct(array_append(sequence(0, abs(x.count - y.count), if(x.step = y.step or least(x.count, y.count) = 1, least(x.count, y.count), 1)), abs(x.count - y.count))),
        k -> struct(x.centre + if(x.count > y.count, k * x.step, 0) as at_lo, y.centre + if(x.count > y.count, 0, k * y.step) as at_hi))""")
    unlike = F.expr("""
      if(x.step <> y.step and x.count > 1 and y.count > 1, concat(
        transform(sequence(0, x.count - 1), k -> struct(x.centre + k * x.step as at_lo, y.centre as at_hi)),
        transform(sequence(0, y.count - 1), k -> struct(x.centre as at_lo, y.centre + k * y.step as at_hi)),
        array(struct(x.centre + (x.count - 1) * x.step as at_lo, y.centre + (y.count - 1) * y.step as at_hi))), null)""")
    both = F.when((F.col("x.count") == 1) & (F.col("y.count") == 1), single).otherwise(F.coalesce(unlike, slides))
    return met.select(F.col("x.key").alias("lo"), F.col("y.key").alias("hi"), F.explode(both).alias("at")).select("lo", "hi", "at.at_lo", "at.at_hi")


def extended(x: np.ndarray, y: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """Equal characters before, and from, position ``i`` of ``x`` and ``j`` of ``y``."""

    def run(a: np.ndarray, b: np.ndarray) -> int:
        n, step, done = min(len(a), len(b)), 512, 0
        while done < n:
            other = a[done : done + step] != b[done : min(done + step, n)][: len(a[done : done + step])] if done + step <= n else a[done:n] != b[done:n]
            k = int(other.argmax()) if len(other) else 0
            if len(other) and other[k]:
                return done + k
            done += len(other)
            step *= 2
        return n

    return run(x[:i][::-1], y[:j][::-1]), run(x[i:], y[j:])


def _verified(least: int):
    def run(batches):
        for batch in batches:
            rows = []
            for lo, hi, text_lo, text_hi, anchors in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = (codes(zlib.decompress(t).decode("utf-8", "surrogatepass")) for t in (text_lo, text_hi))
                done: dict[int, int] = {}
                for anchor in sorted((a["at_lo"], a["at_hi"]) for a in anchors):
                    i, j = anchor
                    if done.get(j - i, -1) > i:
                        continue
                    before, after = extended(x, y, i, j)
                    done[j - i] = i + after
                    if before + after >= least:
                        rows.append((lo, hi, i - before, j - before, before + after))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["lo", "hi", "start_lo", "start_hi", "length"])

    return run


def shared_spans(texts: DataFrame, least: int = LEAST, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Spans ``(lo, hi, start_lo, start_hi, length)`` between class representatives of ``texts(key, text)``, and the membership ``(key, root)``.

    Every pair of texts with a common passage has the longest run around each of its common window centres.
    """
    if not 0 < gram <= least:
        raise ValueError("the gram must lie between 1 and the least length")
    texts = texts.select("key", "text").where(F.col("key").isNotNull() & (F.length("text") >= least))
    same = texts.mapInArrow(classes, "key long, same binary").distinct()
    roots = same.groupBy("same").agg(F.min("key").alias("root"), F.count("*").alias("n")).where("n > 1")
    membership = materialise(same.join(roots, "same").select("key", "root"))
    found = stored(texts.mapInArrow(_windows(least, gram), "hash long, key long, place long, run long"))
    copies = membership.where("key <> root").select("key")
    anchors = materialise(_joined(found, copies, least - gram + 1, gram).groupBy("lo", "hi").agg(F.collect_set(F.struct("at_lo", "at_hi")).alias("anchors")))
    discard(found)
    ends = anchors.select(F.col("lo").alias("key")).unionAll(anchors.select("hi")).distinct()
    wanted = texts.mapInArrow(_packed, "key long, text binary").join(ends, "key", "left_semi").dropDuplicates(["key"])
    met = anchors.join(wanted.toDF("lo", "text_lo"), "lo").join(wanted.toDF("hi", "text_hi"), "hi").select("lo", "hi", "text_lo", "text_hi", "anchors")
    return materialise(met.mapInArrow(_verified(least), "lo long, hi long, start_lo int, start_hi int, length int")), membership


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that share a passage."""
    spans, membership = shared_spans(_texts(spark, folder))
    return spelled(spans.select("lo", "hi").distinct(), membership).toDF("doc_lo", "doc_hi")


def p9_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The shared passages between texts that differ."""
    spans, _ = shared_spans(_texts(spark, folder))
    return spans.select(F.col("lo").alias("doc_lo"), F.col("hi").alias("doc_hi"), "start_lo", "start_hi", "length").distinct()


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """For each document the characters, and their share, that stand in another document too; overlapping spans count once."""
    texts = _texts(spark, folder)
    spans, membership = shared_spans(texts)
    ends = spans.select(F.col("lo").alias("key"), F.col("start_lo").alias("a"), (F.col("start_lo") + F.col("length")).alias("b"))
    ends = ends.unionAll(spans.select("hi", "start_hi", F.col("start_hi") + F.col("length"))).distinct()
    whole = membership.join(texts, "key").select("key", F.lit(0).alias("a"), F.length("text").alias("b"))
    from pyspark.sql import Window

    before = Window.partitionBy("key").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.unionAll(whole).withColumn("reached", F.coalesce(F.max("b").over(before), F.lit(0)))
    covered = ends.groupBy("key").agg(F.sum(F.greatest(F.col("b") - F.greatest("a", "reached"), F.lit(0))).alias("shared_chars"))
    length = texts.dropDuplicates(["key"]).select("key", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0))
    return length.join(covered, "key", "left").select(F.col("key").alias("doc_id"), "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(0.0).alias("share"))


QUERIES = {"p9_found": p9_found, "p9_spans": p9_spans, "p9_shares": p9_shares}
_WINDOWS = f"""docs AS (SELECT doc_id, any_value(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
spots AS (SELECT doc_id, i, hash(substr(text, i, {LEAST})) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - {LEAST - 2})) AS i FROM docs WHERE length(text) >= {LEAST})),
held AS (SELECT DISTINCT doc_id, h FROM spots), shared AS (SELECT h FROM held GROUP BY h HAVING count(*) > 1)"""
ORACLE = {
    "p9_found": f"WITH {_WINDOWS}, kept AS (SELECT doc_id, h FROM held JOIN shared USING (h)) SELECT DISTINCT a.doc_id AS doc_lo, b.doc_id AS doc_hi FROM kept a JOIN kept b USING (h) WHERE a.doc_id < b.doc_id",
    "p9_shares": f"WITH {_WINDOWS}, marks AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM spots JOIN shared USING (h)), covered AS (SELECT doc_id, CAST(sum(least({LEAST}, coalesce(j - i, {LEAST}))) AS BIGINT) AS n FROM marks GROUP BY 1) SELECT doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS n_chars, coalesce(n, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN round(coalesce(n, 0) / length(text), 6) ELSE 0.0 END AS share FROM docs LEFT JOIN covered USING (doc_id)",
}
