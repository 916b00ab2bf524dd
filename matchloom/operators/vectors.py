"""Vector pools, nearest neighbours and multi-vector scores over DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.vectors import doubles, normalised, similarity
from matchloom.session import stored

BLOCK = 4_096


def pooled(rows: DataFrame, keys: list[str], vector: str = "vector", how: str = "mean") -> DataFrame:
    """``keys`` and the normalised element-wise mean or maximum of their vectors; partial sums are formed before the shuffle."""
    parts = rows.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(doubles(F.col(vector))).alias("_at", "_value"))
    parts = parts.groupBy(*keys, "_at").agg((F.avg if how == "mean" else F.max)("_value").alias("_value"))
    pool = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_value"))), lambda x: x["_value"])
    return parts.groupBy(*keys).agg(normalised(pool).alias(vector))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(x, dtype=np.float64) for x in column])


def _nearest(n: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, held = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if not len(asked) or not len(held):
            return pd.DataFrame({"qid": [], "id": [], "distance": []}).astype({"qid": str, "id": str, "distance": float})
        q, c = _matrix(asked.vector), _matrix(held.vector)
        qn, cn = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
        qids, ids = asked.key.to_numpy(), held.key.to_numpy()
        found = []
        for i in range(0, len(q), 256):
            both = qn[i : i + 256, None] * cn[None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.where(both > 0, 1 - (q[i : i + 256] @ c.T) / both, 1.0)
            d = np.round(d, 9) + 0.0
            bar = np.partition(d, n - 1, axis=1)[:, n - 1] if d.shape[1] > n else np.full(len(d), np.inf)
            a, b = np.nonzero(d <= bar[:, None])
            found.append(pd.DataFrame({"qid": qids[i + a], "id": ids[b], "distance": d[a, b]}))
        return pd.concat(found, ignore_index=True)

    return run


#: Queries of one task, corpus rows that it holds at a time, and the sides of one matrix product.
GROUP, HELD, TILE, WIDE = 8_192, 16_384, 512, 512
#: A corpus is scanned in parts where there are few queries: rows of a part, and queries times parts.
PART, SPREAD = 131_072, 65_536
#: 32-bit products of unit vectors err by less; whatever is nearer than that to the bar is computed exactly.
SLACK = np.float32(1e-5)


def _wide(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _units(wide: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (wide / np.where(size > 0, size, 1)[:, None]).astype(np.float32)


def _blocks(files: list[str], held: int):
    """Ids and vectors of a stored corpus, ``held`` rows at a time; what is not finite is near to nothing."""
    rows, ready = [], 0

    def block():
        both = pa.Table.from_batches(rows).combine_chunks()
        rows.clear()
        ids, wide = both.column(0).combine_chunks(), _wide(both.column(1).combine_chunks())
        good = np.flatnonzero(np.isfinite(wide).all(axis=1))
        return (ids, wide) if len(good) == len(wide) else (ids.take(pa.array(good)), wide[good])

    for file in files:
        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(min(held, 8_192), columns=["id", "vector"]):
                if batch.num_rows:
                    rows.append(batch)
                    ready += batch.num_rows
                if ready >= held:
                    yield block()
                    ready = 0
    if rows:
        yield block()


class _Best:
    """The n nearest so far of each query of a tile, and all that tie with the n-th."""

    def __init__(self, count: int, n: int):
        self.n, self.bar = n, np.full(count, -np.inf, np.float32)
        self.row, self.distance, self.ids = np.zeros(0, np.int64), np.zeros(0), pa.array([], pa.string())

    def add(self, row: np.ndarray, distance: np.ndarray, ids: pa.Array) -> None:
        row, distance = np.r_[self.row, row], np.r_[self.distance, distance]
        order = np.lexsort((distance, row))
        self._keep(order, row, distance, pa.concat_arrays([self.ids, ids.cast(pa.string())]))
        size = np.bincount(self.row, minlength=len(self.bar))
        if size.max() > 2 * self.n + 64:  # many ties with the n-th: only the lower ids can stay
            self._keep(self._by_id(), self.row, self.distance, self.ids, exact=True)

    def _keep(self, order, row, distance, ids, exact: bool = False) -> None:
        row, distance = row[order], distance[order]
        starts = np.searchsorted(row, np.arange(len(self.bar) + 1))
        full = np.flatnonzero(np.diff(starts) >= self.n)
        last = np.full(len(self.bar), np.inf)
        last[full] = distance[starts[full] + self.n - 1]
        self.bar[full] = (1 - last[full]).astype(np.float32) - SLACK
        kept = np.flatnonzero((np.arange(len(row)) - starts[row] < self.n) if exact else distance <= last[row])
        self.row, self.distance, self.ids = row[kept], distance[kept], ids.take(pa.array(order[kept]))

    def _by_id(self) -> np.ndarray:
        """The order by query, distance and id; only ids of equal distance are compared."""
        same = (self.row[1:] == self.row[:-1]) & (self.distance[1:] == self.distance[:-1])
        tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
        order = np.arange(len(self.row))
        if len(tied):
            names = self.ids.take(pa.array(tied)).to_pylist()
            at = sorted(range(len(tied)), key=lambda k: (self.row[tied[k]], self.distance[tied[k]], names[k]))
            order[tied] = tied[at]
        return order

    def settled(self) -> None:
        self._keep(self._by_id(), self.row, self.distance, self.ids, exact=True)


def _scan(asked: np.ndarray, files: list[str], n: int, held: int, tile: int):
    """For each tile of ``asked`` its first row and the n nearest: one pass over the corpus, of which ``held`` rows are in memory."""
    size = np.linalg.norm(asked, axis=1)
    unit = _units(asked, size)
    best = [_Best(len(unit[i : i + tile]), n) for i in range(0, len(unit), tile)]
    for ids, wide in _blocks(files, held):
        if not len(wide):
            continue
        width = np.linalg.norm(wide, axis=1)
        other = _units(wide, width)
        for k, found in enumerate(best):
            own, q = slice(k * tile, k * tile + len(found.bar)), unit[k * tile : k * tile + len(found.bar)]
            if not len(found.row) and len(other) > n:
                first = q @ other[: max(4_096, n)].T
                found.bar = np.partition(first, first.shape[1] - n, axis=1)[:, first.shape[1] - n] - SLACK
            row, at = [], []
            for j in range(0, len(other), WIDE):
                s = q @ other[j : j + WIDE].T
                hit = np.flatnonzero(s.max(axis=1) >= found.bar)
                if len(hit):
                    a, b = np.nonzero(s[hit] >= found.bar[hit, None])
                    row.append(hit[a])
                    at.append(j + b)
            if not row:
                continue
            row, at = np.concatenate(row), np.concatenate(at)
            distance = np.ones(len(row))
            for i in range(0, len(row), HELD):
                x, y = row[i : i + HELD], at[i : i + HELD]
                both = size[own][x] * width[y]
                with np.errstate(divide="ignore", invalid="ignore"):
                    exact = 1 - np.einsum("ij,ij->i", asked[own][x], wide[y]) / both
                distance[i : i + HELD] = np.round(np.where(both > 0, exact, 1.0), 9) + 0.0
            found.add(row, distance, ids.take(pa.array(at)))
    for k, found in enumerate(best):
        found.settled()
        yield k * tile, found


def _scanned(parts: list[list[str]], n: int, held: int, tile: int):
    """(qid, id, distance, place) of rows (part, key, vector); equal vectors of a task are searched once."""

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        every = pa.Table.from_batches(rows)
        del rows
        for part in pc.unique(every.column(0)).to_pylist():
            own = every.filter(pc.equal(every.column(0), part)).combine_chunks()
            wide, keys = _wide(own.column(2).combine_chunks()), own.column(1).combine_chunks()
            good = np.flatnonzero(np.isfinite(wide).all(axis=1))
            if not len(good):
                continue
            different, which = np.unique(wide[good], axis=0, return_inverse=True)
            del own, wide
            which = which.reshape(-1)
            order = np.argsort(which, kind="stable")
            start = np.searchsorted(which[order], np.arange(len(different) + 1))
            for first, found in _scan(different, parts[part], n, held, tile):
                edge = np.searchsorted(found.row, np.arange(len(found.bar) + 1))
                nth = np.arange(len(found.row)) - edge[found.row] + 1
                asking = good[order[start[first] : start[first + len(found.bar)]]]
                of = np.repeat(np.arange(len(found.bar)), np.diff(start[first : first + len(found.bar) + 1]))
                for i in range(0, len(asking), tile):
                    each = np.diff(edge)[of[i : i + tile]]
                    take = np.repeat(edge[of[i : i + tile]] - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())
                    at = pa.array(take)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(asking[i : i + tile], each))), found.ids.take(at), pa.array(found.distance[take]), pa.array(nth[take].astype(np.int32))], ["qid", "id", "distance", "place"])

    return run


def _held_files(corpus: DataFrame) -> DataFrame:
    """``corpus(id, vector)`` as files in the shared folder; a table that ``stored`` wrote is taken as it is."""
    kinds = dict(corpus.dtypes)
    if hasattr(corpus, "_stored_at") and kinds.get("id") == "string" and kinds.get("vector") in ("array<double>", "array<float>"):
        return corpus
    return stored(corpus.where(F.col("vector").isNotNull()).select(F.col("id").cast("string").alias("id"), "vector"))


def nearest(queries: DataFrame, corpus: DataFrame, n: int, block: int = HELD) -> DataFrame:
    """``(qid, id, distance, place)``: the n nearest of ``corpus(id, vector)`` by cosine for each of ``queries(qid, vector)``.

    Exact. Both sides are written to the shared folder; a task holds a group of queries with their n nearest so far and reads
    the corpus ``block`` rows at a time, so that neither copies of the corpus nor rows for pairs of blocks are shuffled. Matrix
    products of 32 bits tell which pairs can be among the n nearest, those are computed again in 64 bits. Distances are
    rounded to nine digits, ties go to the lower id. Hand in a table that ``stored`` wrote, and it is not written again.
    """
    held = _held_files(corpus)
    asked = stored(queries.where(F.col("vector").isNotNull()).select(F.col("qid").cast("string").alias("key"), "vector"))
    nc, (nq, keys) = held.count(), asked.agg(F.count("*"), F.countDistinct("key")).first()
    # equal vectors meet in one task and are searched once there, unless so many are equal that one task would hold them all
    most = asked.groupBy(F.xxhash64("vector")).count().agg(F.max("count")).first()[0] or 0
    by = "vector" if most <= GROUP // 4 else "key"
    files = sorted(held.inputFiles()) if nc and nq else []
    count = max(1, min(len(files), nc // PART, SPREAD // max(1, nq)))
    parts = [files[k::count] for k in range(count)]
    groups = max(1, -(-nq // GROUP), min(-(-nq // TILE), 2 * queries.sparkSession.sparkContext.defaultParallelism // count))
    slots = asked.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("part"), "key", F.col("vector").cast("array<double>").alias("vector"))
    slots = slots.withColumn("slot", F.col("part") * groups + F.pmod(F.xxhash64(by), F.lit(groups)).cast("int"))
    slots = slots.repartitionById(groups * count, F.col("slot")).drop("slot")
    met = slots.mapInArrow(_scanned(parts, n, min(block, HELD), min(block, TILE)), "qid string, id string, distance double, place int")
    if count == 1 and nq == keys:
        return met
    place = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return met.withColumn("place", place).where(F.col("place") <= n)


def fused(*scores: DataFrame, keys: list[str]) -> DataFrame:
    """The highest score for each of ``keys`` over all result sets of ``keys`` and ``score``."""
    every = scores[0]
    for more in scores[1:]:
        every = every.unionByName(more)
    return every.groupBy(*keys).agg(F.max("score").alias("score"))


def scored(found: DataFrame, weight: float) -> DataFrame:
    """Found neighbours with a weighted similarity, rounded to nine digits."""
    return found.withColumn("score", F.round(similarity(F.col("distance")) * weight, 9))


def multi_vector_similarity(pairs: DataFrame, keys: list[str], how: str = "max", means: DataFrame | None = None) -> DataFrame:
    """Similarity of a profile's vectors to a query from ``keys`` and ``similarity`` rows: max, mean or weighted by squares.

    ``means``, of the same columns, stands in for keys without any row.
    """
    s = F.col("similarity")
    agg = {"mean": F.avg(s), "weighted": F.sum(s * s * s) / F.greatest(F.sum(s * s), F.lit(1e-10))}.get(how, F.max(s))
    found = pairs.groupBy(*keys).agg(agg.alias("similarity"))
    return found if means is None else found.unionByName(means.join(found, keys, "left_anti").select(*keys, "similarity"))
