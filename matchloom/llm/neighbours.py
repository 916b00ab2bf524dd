"""Problem 3: the k most similar vectors of each vector, within an acceptable loss of accuracy.

Method: a hierarchical k-means tree is fitted to a bounded sample (``SAMPLE`` vectors of a collection) and every vector is
put into a leaf. A query visits leaves best bin first: a priority queue holds the nodes by their distance to the query, the
nearest is taken, an inner node adds its children and a leaf is visited. The number of leaves visited is widened on a
calibration set (``CALIBRATION`` vectors against all) until the wanted recall is reached there.

Neighbouring leaves travel together as buckets of about ``BUCKET`` members, and a leaf above that as several buckets. The
queries of one bucket visit another as a group: a query is sent once to each bucket in which it visits leaves, a bucket once
to each group that visits it, and only the visited leaves are compared, by matrix products. Each task keeps the k nearest of
a query, with ties, so that at most that many rows leave it.

A collection of which only neighbours above a similarity matter is calibrated on those, and needs few leaves. ``p3_recall``
measures the recall against brute force on a query set of every fiftieth vector.

Equal vectors form a class whose least key stands for it in the search. Ties at the k-th place all count as among the k.

Defined cases: vectors that are null, of another length than ``DIMENSIONS``, all zero, or that hold null, NaN or infinite
components stay out; repeated rows of a key count once; a collection with one vector has no neighbours; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.near_copies import spelled
from matchloom.session import materialise, table

DIMENSIONS, K = 64, 5
SAMPLE, CALIBRATION = 50_000, 2_000
BRANCHES, LEAF_SAMPLE, ROUNDS = 24, 25, 8
#: Queries whose distances to all nodes are held at once.
ORDERED = 256
#: Rows that a leaf is meant to hold; it holds more once the sample has too few rows for so many leaves.
LEAF_ROWS = 1_000
BUCKET = 32_768
RECALL, CLOSE_RECALL = 0.95, 0.995
CLOSE = 0.90
#: Neighbours above the wanted similarity that a calibration needs; with fewer it goes by the nearest of any similarity.
LEAST_CALIBRATION = 50


@dataclass
class Tree:
    """Centroids of all nodes but the root, with the children of each node; the root is number -1."""

    centres: np.ndarray
    children: dict[int, list[int]]
    leaves: dict[int, int]

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of each vector, found by descending to the nearest child."""
        found = np.zeros(len(unit), np.int32)
        todo = [(-1, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if node in self.leaves:
                found[rows] = self.leaves[node]
                continue
            own = self.children[node]
            best = (unit[rows] @ self.centres[own].T).argmax(axis=1)
            todo += [(child, rows[best == k]) for k, child in enumerate(own) if (best == k).any()]
        return found

    def visits(self, unit: np.ndarray, most: int) -> list[list[int]]:
        """The first ``most`` leaves of each query, best bin first."""
        return [list(islice(order, most)) for order in self.orders(unit)]

    def orders(self, unit: np.ndarray):
        """For each query the leaves, best bin first, as far as they are asked for; costs stand for a few queries at a time."""
        for i in range(0, len(unit), ORDERED):
            cost = 1 - unit[i : i + ORDERED] @ self.centres.T if -1 not in self.leaves else unit[i : i + ORDERED]
            for row in cost:
                yield self._order(row) if -1 not in self.leaves else iter([0])

    def _order(self, cost: np.ndarray):
        own = self.children[-1]
        queue = list(zip(cost[own].tolist(), own))
        heapq.heapify(queue)
        while queue:
            _, node = heapq.heappop(queue)
            if node in self.leaves:
                yield self.leaves[node]
            else:
                own = self.children[node]
                for found in zip(cost[own].tolist(), own):
                    heapq.heappush(queue, found)


def fit(sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF_SAMPLE, seed: int = 1) -> Tree:
    """The tree of a sample of unit vectors."""
    random = np.random.default_rng(seed)
    tree = Tree(np.zeros((0, sample.shape[1] if sample.ndim == 2 else DIMENSIONS), np.float32), {}, {})
    centres: list[np.ndarray] = []

    def grow(node: int, rows: np.ndarray) -> None:
        if len(rows) <= leaf:
            tree.leaves[node] = len(tree.leaves)
            return
        data = sample[rows]
        own = data[random.choice(len(rows), branches, replace=False)]
        for _ in range(ROUNDS):
            near = (data @ own.T).argmax(axis=1)
            sums = np.zeros_like(own)
            np.add.at(sums, near, data)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            own = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), own)
        near = (data @ own.T).argmax(axis=1)
        held = [k for k in range(branches) if (near == k).any()]
        if len(held) < 2:
            tree.leaves[node] = len(tree.leaves)
            return
        tree.children[node] = []
        for k in held:
            centres.append(own[k])
            child = len(centres) - 1
            tree.children[node].append(child)
            grow(child, rows[near == k])

    grow(-1, np.arange(len(sample)))
    if centres:
        tree.centres = np.array(centres, np.float32)
    return tree


def raw(column) -> np.ndarray:
    """The vectors of a binary column of 32-bit floats."""
    return np.frombuffer(b"".join(column.to_pylist() if hasattr(column, "to_pylist") else column), np.float32).reshape(-1, DIMENSIONS)


def units(column) -> np.ndarray:
    """Unit vectors of a binary column of 32-bit floats."""
    wide = raw(column).astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def _packed(batches):
    """Vectors as bytes, with a digest that is equal for equal vectors."""
    for batch in batches:
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32) + np.float32(0)
        rows = [x.tobytes() for x in flat.reshape(-1, DIMENSIONS)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in rows], pa.binary()), pa.array(rows, pa.binary())], ["key", "same", "vec"])


def valid(vectors: DataFrame) -> DataFrame:
    """``vectors(key, vec array<float>)`` as ``(key, same, vec binary)``, the usable ones, each key once."""
    good = (F.size("vec") == DIMENSIONS) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    used = vectors.where(F.col("key").isNotNull() & F.coalesce(good, F.lit(False))).select("key", F.col("vec").cast("array<float>").alias("vec"))
    return used.mapInArrow(_packed, "key string, same binary, vec binary").dropDuplicates(["key"])


@dataclass
class Buckets:
    """Buckets of leaves: the first bucket of each leaf and the number of buckets it is spread over."""

    first: np.ndarray
    parts: np.ndarray

    @staticmethod
    def of(sizes: np.ndarray, room: int) -> Buckets:
        """Runs of neighbouring leaves that together hold at most ``room`` members; a larger leaf has several of its own."""
        first, parts, now, held = np.zeros(len(sizes), np.int32), np.ones(len(sizes), np.int32), 0, 0
        for leaf, size in enumerate(sizes.tolist()):
            if held and held + size > room:
                now, held = now + 1, 0
            first[leaf] = now
            if size > room:
                parts[leaf] = -(-size // room)
                now += int(parts[leaf])
            else:
                held += size
        return Buckets(first, parts)


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(33)).astype(np.int64)


def _leaves(tree: Tree):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.assign(units(batch.column(0))) if batch.num_rows else np.zeros(0, np.int32))], ["leaf"])

    return run


def _placed(tree: Tree, buckets: Buckets, visits: int):
    """Each vector as the member of a bucket, and, if asked, as a query of each bucket in which it visits leaves."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, ids = units(batch.column(1)), batch.column(0).to_numpy()
            own, asked = tree.assign(unit), np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
            home = buckets.first[own] + (_mixed(ids) % buckets.parts[own]).astype(np.int32)
            at, where, seen = [], [], []
            for i, leaves in zip(asked.tolist(), (islice(x, visits) for x in tree.orders(unit[asked]))):
                by: dict[int, list[int]] = {}
                for leaf in leaves:
                    for part in range(int(buckets.parts[leaf])):
                        by.setdefault(int(buckets.first[leaf]) + part, []).append(leaf)
                at += [i] * len(by)
                where += by.keys()
                seen += [np.array(x, np.int32).tobytes() for x in by.values()]
            n, rows = batch.num_rows, pa.array(np.r_[np.arange(batch.num_rows), np.array(at, np.int64)])
            columns = [batch.column(0).take(rows), pa.array(np.r_[home, np.array(where, np.int32)].astype(np.int32)), pa.array(np.r_[home, home[at]].astype(np.int32)), pa.array(np.r_[own, np.full(len(at), -1)].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([None] * n + seen, pa.binary()), batch.column(1).take(rows)], ["id", "bucket", "home", "leaf", "visited", "vec"])

    return run


PLACED = "id long, bucket int, home int, leaf int, visited binary, vec binary"


def _bucket_search(k: int, least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members, asking = pdf[pdf["leaf"] >= 0].sort_values(["leaf", "id"]), pdf[pdf["leaf"] < 0].sort_values("id")
        empty = pd.DataFrame({"q": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        if not len(members) or not len(asking):
            return empty
        m, q, mid, qid = units(members.vec), units(asking.vec), members.id.to_numpy(), asking.id.to_numpy()
        raw_m, raw_q = raw(members.vec), raw(asking.vec)
        seen = [np.frombuffer(x, np.int32) for x in asking.visited]
        owner, leaf_of = np.repeat(np.arange(len(q)), [len(x) for x in seen]), np.concatenate(seen)
        order = np.argsort(leaf_of, kind="stable")
        owner, leaf_of, leaves = owner[order], leaf_of[order], members.leaf.to_numpy()
        kth = np.full((len(q), k), -2, np.float32)
        steps = []
        for leaf in np.unique(leaves):
            a, b = np.searchsorted(leaves, [leaf, leaf + 1])
            c, d = np.searchsorted(leaf_of, [leaf, leaf + 1])
            steps += [(owner[x : min(x + 512, d)], slice(y, min(y + 8_192, b))) for x in range(c, d, 512) for y in range(a, b, 8_192)]

        def scores(rows, part):
            found = q[rows] @ m[part].T
            found[qid[rows, None] == mid[None, part]] = -2
            return found

        for rows, part in steps:  # the k best similarities of each query
            found = scores(rows, part)
            if found.shape[1] > k:
                found = -np.partition(-found, k - 1, axis=1)[:, :k]
            kth[rows] = -np.sort(-np.concatenate([kth[rows], found], axis=1), axis=1)[:, :k]
        bar, out = np.maximum(np.maximum(kth[:, k - 1], least) - np.float32(2e-6), -1.5), []
        for rows, part in steps:  # and who reaches them, ties included
            if (kth[rows, 0] < bar[rows]).all():
                continue
            a, b = np.nonzero(scores(rows, part) >= bar[rows, None])
            # unit vectors of 32 bits rank the candidates; the similarity itself comes from the vectors as given
            x, y = raw_q[rows[a]].astype(np.float64), raw_m[part][b].astype(np.float64)
            exact = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            out.append(pd.DataFrame({"q": qid[rows[a]], "n": mid[part][b], "similarity": np.round(exact, 9)}))
        if not out:
            return empty
        found = pd.concat(out, ignore_index=True)
        found = found[found.similarity >= least - 1e-9]
        return found[found.groupby("q").similarity.rank(method="min", ascending=False) <= k]

    return run


def searched(firsts: DataFrame, tree: Tree, visits: int, k: int, least: float) -> DataFrame:
    """``(q, n, similarity, place)``: for the rows of ``firsts(id, vec, asked)`` that are asked, the k nearest in the leaves they visit, ties included."""
    sizes = np.zeros(len(tree.leaves), np.int64)
    for row in firsts.select("vec").mapInArrow(_leaves(tree), "leaf int").groupBy("leaf").count().collect():  # one row for each leaf, of which the sample bounds the number
        sizes[row["leaf"]] = row["count"]
    # placed twice, once for the groups alone: the visits are quick to repeat, and the vectors would be written twice
    placed = firsts.select("id", "vec", "asked").mapInArrow(_placed(tree, Buckets.of(sizes, BUCKET), visits), PLACED)
    asking = placed.where("leaf < 0")
    groups = materialise(asking.select("bucket", "home").distinct())
    members = placed.where("leaf >= 0").drop("home").join(groups, "bucket").select(asking.columns)
    found = asking.unionAll(members).groupBy("bucket", "home").applyInPandas(_bucket_search(k, least), "q long, n long, similarity double")
    place = F.rank().over(Window.partitionBy("q").orderBy(F.desc("similarity")))
    return materialise(found.withColumn("place", place).where(F.col("place") <= k))


def _nearest_of_sample(ids: np.ndarray, sample: np.ndarray, tree: Tree, k: int):
    """For each sample vector the k nearest rows of this partition, with their leaves."""

    def run(batches):
        best, who, leaf = (np.full((len(ids), k), -2, np.float32), np.full((len(ids), k), -1, np.int64), np.zeros((len(ids), k), np.int32))
        for batch in batches:
            rid, all_units = batch.column(0).to_numpy(), units(batch.column(1)) if batch.num_rows else np.zeros((0, DIMENSIONS), np.float32)
            for i in range(0, len(rid), 2048):
                unit, own = all_units[i : i + 2048], rid[i : i + 2048]
                s = sample @ unit.T
                s[ids[:, None] == own[None, :]] = -2
                take = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                both = np.concatenate([best, np.take_along_axis(s, take, 1)], axis=1)
                names = np.concatenate([who, own[take]], axis=1)
                homes = np.concatenate([leaf, tree.assign(unit)[take]], axis=1)
                order = np.argsort(-both, axis=1, kind="stable")[:, :k]
                best, who, leaf = (np.take_along_axis(x, order, 1) for x in (both, names, homes))
        a, b = np.nonzero(who >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(best[a, b].astype(np.float64)), pa.array(leaf[a, b])], ["at", "similarity", "leaf"])

    return run


def _steps(tree: Tree, sample: np.ndarray, asked: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """How many leaves the query ``at`` has visited when it comes to ``leaf``, for each ``(at, leaf)`` asked for. A walk ends
    with the last leaf asked of it, and nothing else of it is kept: orders of all leaves would fill the driver."""
    wanted: dict[int, set[int]] = {}
    for at, leaf in asked:
        wanted.setdefault(at, set()).add(leaf)
    found = {}
    for at, order in enumerate(tree.orders(sample)):
        left = set(wanted.get(at, ()))
        for step, leaf in enumerate(order if left else (), 1):
            if leaf in left:
                found[at, leaf] = step
                left.discard(leaf)
                if not left:
                    break
    return found


def calibrated(firsts: DataFrame, tree: Tree, n: int, k: int, least: float, recall: float, calibration: int = CALIBRATION) -> int:
    """The fewest leaves a query must visit for the wanted recall on a calibration set."""
    if len(tree.leaves) == 1:
        return 1
    share = min(1.0, 1.2 * calibration / max(1, n))
    rows = firsts.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000)).select("id", "vec").limit(calibration).collect()
    if not rows:
        return 1
    ids, sample = np.array([r.id for r in rows]), units([bytes(r.vec) for r in rows])
    near = firsts.select("id", "vec").mapInArrow(_nearest_of_sample(ids, sample, tree, k), "at long, similarity double, leaf int")
    place = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("similarity"), "leaf"))
    near = near.withColumn("place", place).where(F.col("place") <= k).collect()  # at most k rows for each sample vector
    steps = _steps(tree, sample, [(r["at"], r["leaf"]) for r in near])
    needed = sorted(steps[r["at"], r["leaf"]] for r in near if r["similarity"] >= least)
    if len(needed) < LEAST_CALIBRATION:
        needed = sorted(steps[r["at"], r["leaf"]] for r in near if r["similarity"] >= least or r["place"] == 1)
    if not needed:
        return min(3, len(tree.leaves))
    return max(min(2, len(tree.leaves)), needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def prepared(vectors: DataFrame) -> tuple[DataFrame, DataFrame, Tree, int]:
    """Class representatives ``(id, key, vec, copies)``, membership ``(key, root)``, the tree and the number of representatives."""
    packed = materialise(valid(vectors))
    classes = packed.groupBy("same").agg(F.min("key").alias("key"), F.count("*").alias("copies"))
    shared = classes.where("copies > 1").select("same", F.col("key").alias("root"), "copies")
    membership = materialise(packed.join(shared, "same").select("key", "root", "copies"))
    firsts = packed.join(membership.where("key <> root").select("key"), "key", "left_anti").join(membership.where("key = root").select("key", "copies"), "key", "left")
    firsts = materialise(firsts.select(F.monotonically_increasing_id().alias("id"), "key", "vec", F.coalesce("copies", F.lit(1)).alias("copies")))
    n = firsts.count()
    share = min(1.0, 1.2 * SAMPLE / max(1, n))
    sample = firsts.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("vec").limit(SAMPLE).collect()
    fitted = fit(units([bytes(r.vec) for r in sample]) if sample else np.zeros((0, DIMENSIONS), np.float32), leaf=max(LEAF_SAMPLE, len(sample) * LEAF_ROWS // max(1, n)))
    return firsts, membership.select("key", "root"), fitted, n


def neighbours(vectors: DataFrame, k: int = K, least: float = -1.0, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """``(lo, hi, similarity, place, copies_hi)`` between representatives of ``vectors(key, vec)``, and the membership of classes.

    ``hi`` is among the k most similar of ``lo``; only neighbours of at least ``least`` are looked for.
    """
    firsts, membership, tree, n = prepared(vectors)
    visits = calibrated(firsts, tree, n, k, least, recall)
    found = searched(firsts.withColumn("asked", F.lit(True)), tree, visits, k, least)
    names = firsts.select("id", "key", "copies")
    named = found.join(names.toDF("q", "lo", "copies_lo"), "q").join(names.toDF("n", "hi", "copies_hi"), "n")
    better = Window.partitionBy("lo").orderBy(F.desc("similarity")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("lo", "similarity")
    named = named.withColumn("place", F.sum("copies_hi").over(better) - F.sum("copies_hi").over(same) + F.col("copies_lo")).where(F.col("place") <= k)
    return named.select("lo", "hi", "similarity", "place", "copies_hi"), membership


def collections(rows: DataFrame) -> dict[str, DataFrame]:
    """The vectors of each field by its letter."""
    rows = rows.where(F.col("file_hash").isNotNull())
    single = rows.select(F.concat("file_hash", F.lit(":s")).alias("key"), F.col("summary_embedding").alias("vec"))
    many = rows.select("file_hash", F.posexplode("representative_embeddings").alias("k", "vec")).select(F.concat("file_hash", F.lit(":r"), "k").alias("key"), "vec")
    return {"s": single, "r": many}


def _collections(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return collections(table(spark, folder, "company_profile_embeddings"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of at least 0.90 of which one is among the five most similar of the other."""
    parts = []
    for vectors in _collections(spark, folder).values():
        links, membership = neighbours(vectors, K, CLOSE, CLOSE_RECALL)
        links = links.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct()
        parts.append(materialise(spelled(links, membership)))
    return parts[0].unionAll(parts[1]).toDF("vec_lo", "vec_hi")


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar vectors of every vector; of equal ones the least keys."""
    parts = []
    for field, vectors in _collections(spark, folder).items():
        links, membership = neighbours(vectors)
        named = Window.partitionBy("root").orderBy("key")
        heads = membership.withColumn("nth", F.row_number().over(named)).where(F.col("nth") <= K + 1).groupBy("root").agg(F.collect_list("key").alias("keys"))
        own = heads.select(F.col("root").alias("lo"), F.col("keys"), F.lit(1.0).alias("similarity"))
        near = links.join(heads.withColumnRenamed("root", "hi"), "hi", "left").select("lo", F.coalesce("keys", F.array("hi")).alias("keys"), "similarity")
        ranked = own.unionByName(near).select("lo", F.explode(F.slice("keys", 1, K + 1)).alias("hi"), "similarity")
        order = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("away"), F.col("hi"))))
        ranked = ranked.groupBy("lo").agg(order.alias("near"))
        members = ranked.join(membership.withColumnRenamed("root", "lo"), "lo", "left").withColumn("key", F.coalesce("key", "lo"))
        five = F.slice(F.filter("near", lambda x: x["hi"] != F.col("key")), 1, K)
        parts.append(materialise(members.select("key", F.posexplode(five).alias("k", "x")).select(F.lit(field).alias("field"), F.col("key").alias("vec"), (F.col("k") + 1).alias("place"), F.col("x.hi").alias("neighbour"), (-F.col("x.away")).alias("similarity"))))
    return parts[0].unionAll(parts[1])


def p3_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of the five nearest against brute force, for a query set of every fiftieth vector against all."""
    parts = []
    for field, vectors in _collections(spark, folder).items():
        firsts, _, tree, n = prepared(vectors)
        visits = calibrated(firsts, tree, n, K, -1.0, RECALL)
        asked = firsts.withColumn("asked", F.pmod(F.xxhash64("key"), F.lit(50)) == 0)
        by_tree = searched(asked, tree, visits, K, -1.0)
        exact = searched(asked, Tree(np.zeros((0, DIMENSIONS), np.float32), {}, {-1: 0}), 1, K, -1.0)
        met = exact.select("q", "n").join(by_tree.select("q", "n", F.lit(1).alias("hit")), ["q", "n"], "left")
        parts.append(materialise(met.agg(F.lit(field).alias("field"), F.countDistinct("q").alias("n_queries"), F.round(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)), 4).alias("recall"), F.lit(visits).alias("leaves_visited"), F.lit(len(tree.leaves)).alias("leaves"))))
    return parts[0].unionAll(parts[1])


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours, "p3_recall": p3_recall}
_VECTORS = f"""raw AS (SELECT 's' AS field, file_hash || ':s' AS vec, summary_embedding AS v FROM company_profile_embeddings
  UNION ALL SELECT 'r', file_hash || ':r' || (i - 1), representative_embeddings[i] FROM (SELECT file_hash, representative_embeddings, unnest(range(1, len(representative_embeddings) + 1)) AS i FROM company_profile_embeddings)),
vectors AS (SELECT field, vec, any_value(CAST(v AS DOUBLE[])) AS v FROM raw WHERE vec IS NOT NULL AND v IS NOT NULL AND len(v) = {DIMENSIONS} AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0 GROUP BY 1, 2),
pairs AS (SELECT a.field, a.vec, b.vec AS other, round(list_cosine_similarity(a.v, b.v), 9) AS similarity FROM vectors a JOIN vectors b ON a.field = b.field AND a.vec <> b.vec)"""
ORACLE = {
    "p3_found": f"WITH {_VECTORS}, near AS (SELECT *, rank() OVER (PARTITION BY vec ORDER BY similarity DESC) AS place FROM pairs) SELECT DISTINCT least(vec, other) AS vec_lo, greatest(vec, other) AS vec_hi FROM near WHERE place <= {K} AND similarity >= {CLOSE}",
    "p3_neighbours": f"WITH {_VECTORS}, near AS (SELECT *, row_number() OVER (PARTITION BY vec ORDER BY similarity DESC, other) AS place FROM pairs) SELECT field, vec, CAST(place AS INTEGER) AS place, other AS neighbour, similarity FROM near WHERE place <= {K}",
}
