"""Problem 7: pack texts into containers of a fixed number of tokens with little unused space.

Method: an inverted index with BM25 weights over all items, sharded by content: the shards are leaves of a k-means tree over
the leading word directions of a sample. Every item is a member of one shard, and a seed asks the ``VISITS`` shards nearest
to it, best bin first; in each shard all members that fit are scored exactly. Seeds are the items above half the capacity
and a share of the others. In each round an unused item goes to the seed that scores it highest, and a seed takes its items
by score as long as they fit. What is gathered so, and the items left over, are packed as units within shards of like
content: the largest unused unit seeds a container, unused neighbours fill it by score, and the last gap takes the unit that
fits it best. Containers that stay below ``FULL`` give their items back, and these are packed again in shards of
neighbouring leaves. The number of shards asked is fixed, so that the work grows with the items and not with their square;
``p7_recall`` measures the neighbours reached against brute force.

A text above the capacity is cut into full containers and a rest, which is packed as an item. Terms are counted in a
hashed vocabulary of ``BINS`` entries, so that the frequencies have a fixed size wherever they are held.

Defined cases: null and empty texts have no tokens and are not packed; repeated rows of a key count once; a rest or text
as large as the capacity fills a container alone.
"""

from __future__ import annotations

from collections import Counter
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm import tokens
from matchloom.llm.neighbours import Tree, fit
from matchloom.session import discard, materialise, stored, table

CAPACITY = 1_024
SHARD_ITEMS = 1_000
BINS = 1 << 18
K1, B = 1.2, 0.75
FULL = 0.97
#: The space: words and documents it is fitted on, and its directions.
SPACE_WORDS, SPACE_SAMPLE, DIRECTIONS = 4_096, 3_000, 128
TREE_SAMPLE, LEAF_SAMPLE = 20_000, 10
#: Shards that a seed asks, members of a block that a task holds, neighbours kept of a seed, and those that recall is measured on.
VISITS, BLOCK, NEIGHBOURS, K = 4, 4_096, 8, 5
#: One in so many of the items up to half the capacity is a seed.
SEED_EVERY = 4
ROUNDS = 3
#: A gap of at least 1 / GAP of the capacity is left for another item. Rounds of packing poor containers again, each in shards so many times as large.
GAP, AGAIN, WIDER = 8, 2, 4
MEMBERS = "n_tokens int, seed boolean, terms binary, counts binary"
PACKED = "container_id string, item_pos int, doc_id long, start_token int, n_tokens int"


def _items(capacity: int, vocabulary: str):
    """Each text's size and the counts of its hashed terms."""

    def run(batches):
        pieces = tokens.Pieces(vocabulary)
        for batch in batches:
            keys, sizes, terms, counts = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, words = tokens.counted(text, pieces)
                if not n:
                    continue
                own, k = np.unique(words & np.uint32(BINS - 1), return_counts=True)
                keys.append(key)
                sizes.append(n)
                terms.append(own.astype(np.uint32).tobytes())
                counts.append(k.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "size", "terms", "counts"])

    return run


def _frequencies(batches):
    """Documents by term in this partition, and the sum of their lengths under -1 and -2."""
    total, length, documents = np.zeros(BINS, np.int64), 0, 0
    for batch in batches:
        for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[np.frombuffer(terms, np.uint32)] += 1
            length += int(np.frombuffer(counts, np.uint32).sum(dtype=np.int64))
            documents += 1
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[held, -1, -2], pa.int64()), pa.array(np.r_[total[held], length, documents], pa.int64())], ["term", "n"])


def _cut(capacity: int):
    """Full containers of texts above the capacity are marked as such; the rest of a text is an item."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, size, terms, counts in zip(*(c.to_pylist() for c in batch.columns)):
                for k in range(size // capacity):
                    rows.append((key, k * capacity, capacity, None, None))
                if size % capacity:
                    rows.append((key, size - size % capacity, size % capacity, terms, counts))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["doc_id", "start_token", "n_tokens", "terms", "counts"])

    return run


class Index:
    """BM25 weights of a set of items: the terms of each item, and, once asked for, the items of each term."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n, self.terms = len(terms), terms
        sizes = np.fromiter(map(len, terms), np.int64, len(terms))
        self.start = np.r_[0, np.cumsum(sizes)]
        self.flat = np.concatenate(terms) if terms else np.zeros(0, np.uint32)
        tf = np.concatenate(counts).astype(np.float32) if counts else np.zeros(0, np.float32)
        length = np.add.reduceat(np.r_[tf, np.float32(0)], self.start[:-1]) * (sizes > 0) if self.n else np.zeros(0, np.float32)
        room = np.repeat(np.float32(K1) * (1 - B + B * length.astype(np.float32) / np.float32(mean)), sizes)
        self.flat_weight = (idf[self.flat] * tf * np.float32(K1 + 1) / (tf + room)).astype(np.float32)

    @cached_property
    def owner_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.start))

    @cached_property
    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms held, first and last posting of each, and the item and weight of each posting."""
        order = np.argsort(self.flat, kind="stable")
        held, first = np.unique(self.flat[order], return_index=True)
        return held, first, np.r_[first[1:], len(self.flat)], self.owner_of[order], self.flat_weight[order]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 score of every item for the terms."""
        held, first, last, owner, weight = self.postings
        place = np.searchsorted(held, terms)
        met = place < len(held)
        place = place[met][held[place[met]] == terms[met]]
        at = _ranges(first[place], last[place])
        return np.bincount(owner[at], weight[at], self.n)

    @cached_property
    def columns(self) -> tuple[np.ndarray, int]:
        """Column of every term of the vocabulary among those held here, -1 for others, and their number."""
        held = np.zeros(BINS, bool)
        held[self.flat] = True
        column = np.full(BINS, -1, np.int32)
        column[held] = np.arange(int(held.sum()))
        return column, int(held.sum())

    def table(self) -> np.ndarray:
        """The weights as a matrix of items by held terms."""
        column, width = self.columns
        full = np.zeros((self.n, width), np.float32)
        full[self.owner_of, column[self.flat]] = self.flat_weight
        return full

    def asked(self, terms: list[np.ndarray]) -> np.ndarray:
        """Queries as a matrix of ones at the held terms they ask for."""
        column, width = self.columns
        place = column[np.concatenate(terms)]
        full = np.zeros((len(terms), width), np.float32)
        full[np.repeat(np.arange(len(terms)), [len(t) for t in terms])[place >= 0], place[place >= 0]] = 1
        return full


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    size = last - first
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def _arrays(terms, counts) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.frombuffer(x, np.uint32) for x in terms], [np.frombuffer(x, np.uint32) for x in counts]


class Space:
    """Directions in which the products of items' BM25 weights and asked words are kept best, from a sample."""

    def __init__(self, sample: Index, df: np.ndarray, idf: np.ndarray):
        self.root = np.sqrt(np.maximum(idf, 1e-3)).astype(np.float32)
        hot = np.argsort(-(df * idf), kind="stable")[:SPACE_WORDS]
        self.column = np.full(BINS, -1, np.int32)
        self.column[hot] = np.arange(len(hot))
        held = np.zeros((sample.n, len(hot)), np.float32)
        at = self.column[sample.flat]
        held[sample.owner_of[at >= 0], at[at >= 0]] = (sample.flat_weight / self.root[sample.flat])[at >= 0]
        y = held @ np.random.default_rng(1).normal(size=(len(hot), DIRECTIONS + 16)).astype(np.float32)
        for _ in range(3):
            y = np.linalg.qr(held @ (held.T @ y))[0]
        self.directions = np.ascontiguousarray(np.linalg.svd(y.T @ held, full_matrices=False)[2][:DIRECTIONS].T, dtype=np.float32)

    def _sums(self, flat: np.ndarray, value: np.ndarray, start: np.ndarray) -> np.ndarray:
        out = np.zeros((len(start) - 1, self.directions.shape[1]), np.float32)
        at = self.column[flat]
        for i in range(len(out)):
            own, worth = at[start[i] : start[i + 1]], value[start[i] : start[i + 1]]
            out[i] = worth[own >= 0] @ self.directions[own[own >= 0]]
        return out

    def members(self, index: Index) -> np.ndarray:
        return self._sums(index.flat, index.flat_weight / self.root[index.flat], index.start)

    def queries(self, terms: list[np.ndarray]) -> np.ndarray:
        flat = np.concatenate(terms).astype(np.int64) if terms else np.zeros(0, np.int64)
        return self._sums(flat, self.root[flat], np.r_[0, np.cumsum([len(t) for t in terms], dtype=np.int64)])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _nearest(ids: np.ndarray, asked: list[np.ndarray], space: Space, tree: Tree, idf: np.ndarray, mean: float):
    """For each asked item the K best of this partition by exact score, with their leaves."""

    def run(batches):
        found = [[] for _ in ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            index = Index(*_arrays(batch.column(1).to_pylist(), batch.column(2).to_pylist()), idf, mean)
            own, leaf = batch.column(0).to_numpy(), tree.assign(_unit(space.members(index)))
            for k, terms in enumerate(asked):
                score = index.scores(terms)
                score[own == ids[k]] = -1
                best = np.argsort(-score, kind="stable")[:K]
                found[k] = sorted(found[k] + [(-float(score[i]), int(own[i]), int(leaf[i])) for i in best if score[i] > 0])[:K]
        rows = [(int(q), n, leaf, -s) for q, near in zip(ids, found) for s, n, leaf in near]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.float64()))], ["q", "n", "leaf", "score"])

    return run


def nearest(items: DataFrame, asked: list, space: Space, tree: Tree, idf: np.ndarray, mean: float) -> DataFrame:
    """``(q, n, leaf, score)``: the K best of all items for each asked row, by brute force."""
    run = _nearest(np.array([r.doc_id for r in asked], np.int64), [np.frombuffer(r.terms, np.uint32) for r in asked], space, tree, idf, mean)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "n")
    found = items.select("doc_id", "terms", "counts").mapInArrow(run, "q long, n long, leaf int, score double")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= K).drop("place")


def _members(space: Space, tree: Tree, idf: np.ndarray, mean: float):
    """Each item with its leaf."""

    def run(batches):
        for batch in batches:
            terms, counts = _arrays(batch.column("terms").to_pylist(), batch.column("counts").to_pylist())
            leaf = tree.assign(_unit(space.members(Index(terms, counts, idf, mean)))) if batch.num_rows else np.zeros(0, np.int32)
            yield batch.append_column("leaf", pa.array(leaf, pa.int32()))

    return run


def _asking(space: Space, tree: Tree, visits: int):
    """Each seed as a query of every leaf it visits."""

    def run(batches):
        for batch in batches:
            terms = [np.frombuffer(x, np.uint32) for x in batch.column("terms").to_pylist()]
            seen = tree.visits(_unit(space.queries(terms)), visits) if batch.num_rows else []
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in seen]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in range(2)] + [pa.array([y for x in seen for y in x], pa.int32()), batch.column(2).take(at)], ["doc_id", "n_tokens", "leaf", "terms"])

    return run


def _block_search(idf: np.ndarray, mean: float, capacity: int | None, k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members, asking = pdf[~pdf["query"]].sort_values("doc_id"), pdf[pdf["query"]]
        found = []
        if len(members) and len(asking):
            index = Index(*_arrays(members.terms, members.counts), idf, mean)
            weights, ids, sizes = index.table().T, members.doc_id.to_numpy(), members.n_tokens.to_numpy()
            for i in range(0, len(asking), 256):
                part = asking.iloc[i : i + 256]
                own, size = part.doc_id.to_numpy(), part.n_tokens.to_numpy()
                score = index.asked([np.frombuffer(x, np.uint32) for x in part.terms]) @ weights
                score[own[:, None] == ids[None, :]] = 0
                if capacity is not None:
                    score[sizes[None, :] > capacity - size[:, None]] = 0
                near = np.argpartition(-score, min(k, len(ids)) - 1, axis=1)[:, :k]
                a, b = np.nonzero(np.take_along_axis(score, near, 1) > 0)
                found.append(pd.DataFrame({"q": own[a], "n": ids[near[a, b]], "size": sizes[near[a, b]], "score": score[a, near[a, b]].astype(np.float64)}))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"q": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "size": np.zeros(0, np.int32), "score": np.zeros(0)})

    return run


def searched(members: DataFrame, space: Space, tree: Tree, idf: np.ndarray, mean: float, visits: int, capacity: int | None, k: int) -> DataFrame:
    """``(q, n, size, score)``: for the seeds of ``members(doc_id, n_tokens, seed, terms, counts, leaf)`` the k best members of the leaves they visit; with a capacity only those that fit beside them."""
    sizes = materialise(members.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    asks = members.where("seed").select("doc_id", "n_tokens", "terms").mapInArrow(_asking(space, tree, visits), "doc_id long, n_tokens int, leaf int, terms binary")
    asks = asks.join(F.broadcast(sizes), "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "doc_id", "n_tokens", F.lit(True).alias("query"), "terms", F.lit(None).cast("binary").alias("counts"))
    held = members.join(F.broadcast(sizes), "leaf").select("leaf", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), "doc_id", "n_tokens", F.lit(False).alias("query"), "terms", "counts")
    found = held.unionAll(asks).groupBy("leaf", "block").applyInPandas(_block_search(idf, mean, capacity, k), "q long, n long, size int, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "n"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _filled(capacity: int):
    """The items that a seed takes of those that chose it, by score as long as they fit; the gap behind an item must be small, or hold another."""

    def run(batches):
        for batch in batches:
            rows = []
            for q, left, near in zip(*(c.to_pylist() for c in batch.columns)):
                for x in near:
                    gap = left - x["size"]
                    if gap >= capacity // GAP or 0 <= gap <= (1 - FULL) * capacity:
                        left = gap
                        rows.append((q, x["n"], x["size"], -x["away"]))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.float64()))], ["q", "n", "size", "score"])

    return run


def gathered(edges: DataFrame, items: DataFrame, capacity: int) -> DataFrame:
    """``(q, n, size, score)``: each item n once, under the seed q that took it; no seed that holds items is itself taken.

    ``edges(q, n, size, score)`` are the neighbours of the seeds among ``items(doc_id, n_tokens, seed)``.
    """
    spark = items.sparkSession
    taken = spark.createDataFrame([], "q long, n long, size int, score double")
    for number in range(ROUNDS):
        # large items seed first; the others seed from the second round on if nobody took them
        asks = items.where("seed" if number else F.col("n_tokens") * 2 > capacity).select(F.col("doc_id").alias("q"), "n_tokens")
        asks = asks.join(taken.select(F.col("n").alias("q")), "q", "left_anti")
        held = taken.groupBy("q").agg(F.sum("size").alias("held"))
        left = asks.join(held, "q", "left").select("q", (F.lit(capacity) - F.col("n_tokens") - F.coalesce("held", F.lit(0))).cast("int").alias("left"))
        open_ = edges.join(left, "q").where(F.col("size") <= F.col("left"))
        open_ = open_.join(taken.select("n"), "n", "left_anti").join(asks.select(F.col("q").alias("n")), "n", "left_anti")
        choice = open_.groupBy("n").agg(F.min(F.struct((-F.col("score")).alias("away"), "q", "left", "size")).alias("c"))
        met = choice.groupBy("c.q", "c.left").agg(F.sort_array(F.collect_list(F.struct("c.away", "n", "c.size"))).alias("near"))
        taken = materialise(taken.unionAll(met.select("q", "left", "near").mapInArrow(_filled(capacity), "q long, n long, size int, score double")))
    return taken


def packed_shard(sizes: np.ndarray, index: Index, capacity: int) -> list[list[int]]:
    """Containers of item numbers, each item once."""
    order = np.argsort(-sizes, kind="stable")
    used = np.zeros(len(sizes), bool)
    by_size = sizes[order]
    containers = []
    for seed in order:
        if used[seed]:
            continue
        used[seed] = True
        held, left = [int(seed)], capacity - int(sizes[seed])
        free = order[np.searchsorted(-by_size, -left) :]
        free = free[~used[free]]
        if len(free) and left:
            ranked = free[np.lexsort((free, -index.scores(index.terms[int(seed)])[free]))]
            small = int(sizes[free[-1]])
            for item in ranked:
                size = int(sizes[item])
                # the gap behind this item must be nil, or hold another item; else the best fit below takes it
                if size <= left and (left - size >= max(small, capacity // GAP) or left == size):
                    used[item] = True
                    held.append(int(item))
                    left -= size
                    if left < small:
                        break
            while left >= small:
                fit = order[np.searchsorted(-by_size, -left) :]
                fit = fit[~used[fit]]
                if not len(fit):
                    break
                item = int(fit[0])
                used[item] = True
                held.append(item)
                left -= int(sizes[item])
        containers.append(held)
    return containers


def _packer(capacity: int, idf: np.ndarray, mean: float, tag: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True], ignore_index=True)
        index = Index(*_arrays(pdf.terms, pdf.counts), idf, mean)
        name = f"{tag}{pdf.leaf_group[0]}-{pdf.part[0]}"
        rows = [(f"{name}-{k}", place, item) for k, held in enumerate(packed_shard(pdf.n_tokens.to_numpy(np.int64), index, capacity)) for place, item in enumerate(held)]
        names, places, units = zip(*rows)
        out = pdf.iloc[list(units)]
        filled = pd.Series(out.n_tokens.to_numpy()).groupby(list(names)).transform("sum").to_numpy()
        return pd.DataFrame({"container_id": names, "place": places, "doc_id": out.doc_id.to_numpy(), "leaf": out.leaf.to_numpy(), "n_tokens": out.n_tokens.to_numpy(), "filled": filled, "terms": out.terms.to_numpy(), "counts": out.counts.to_numpy()})

    return run


def indexed(items: DataFrame, leaf_rows: int) -> tuple[np.ndarray, float, Space, Tree]:
    """Weights, mean length, space and tree of ``items(doc_id, terms, counts)``."""
    spark = items.sparkSession
    frequencies = items.select("terms", "counts").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df, length, documents = np.zeros(BINS, np.float64), 0, 0
    for row in frequencies.toLocalIterator():  # at most BINS + 2 rows
        if row.term >= 0:
            df[row.term] = row.n
        elif row.term == -1:
            length = row.n
        else:
            documents = row.n
    idf = np.log(1 + (documents - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = max(1.0, length / max(1, documents))
    share = min(1.0, 1.2 * TREE_SAMPLE / max(1, documents))
    rows = items.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000)).select("doc_id", "terms", "counts").limit(TREE_SAMPLE).collect()
    terms, counts = _arrays([r.terms for r in rows], [r.counts for r in rows])
    space = Space(Index(terms[:SPACE_SAMPLE], counts[:SPACE_SAMPLE], idf, mean), df, idf)
    leaf = max(LEAF_SAMPLE, len(rows) * leaf_rows // max(1, documents))
    tree = fit(_unit(space.members(Index(terms, counts, idf, mean))), branches=min(24, leaf), leaf=leaf)
    return idf, mean, space, tree


def _counted(texts: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    items = texts.where(F.col("key").isNotNull() & (F.length("text") > 0)).select("key", "text")
    items = stored(items.mapInArrow(_items(capacity, vocabulary), "doc_id long, size int, terms binary, counts binary"))
    # only keys are grouped to see whether any is repeated; the wide rows travel only if one is
    if items.groupBy("doc_id").count().where("count > 1").isEmpty():
        return items
    once = stored(items.dropDuplicates(["doc_id"]))
    discard(items)
    return once


def pack(texts: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, vocabulary: str = tokens.VOCABULARY, visits: int = VISITS) -> DataFrame:
    """``texts(key, text)`` as ``(container_id, item_pos, doc_id, start_token, n_tokens)``."""
    if capacity < 1:
        raise ValueError("the capacity must be at least one token")
    items = _counted(texts, vocabulary, capacity)
    spark = items.sparkSession
    idf, mean, space, tree = indexed(items, shard_items)
    cut = items.mapInArrow(_cut(capacity), "doc_id long, start_token int, n_tokens int, terms binary, counts binary")
    whole = stored(cut.where("terms is null").select(F.concat_ws("-", F.lit("w"), "doc_id", "start_token").alias("container_id"), F.lit(0).alias("item_pos"), "doc_id", "start_token", "n_tokens"))
    seed = (F.col("n_tokens") * 2 > capacity) | (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SEED_EVERY)) == 0)
    rest = cut.where("terms is not null").select("doc_id", "start_token", "n_tokens", seed.alias("seed"), "terms", "counts")
    members = stored(rest.mapInArrow(_members(space, tree, idf, mean), f"doc_id long, start_token int, {MEMBERS}, leaf int"))
    discard(items)
    small = stored(members.select("doc_id", "start_token", "n_tokens", "seed"))
    edges = stored(searched(members, space, tree, idf, mean, visits, capacity, NEIGHBOURS))
    taken = gathered(edges, small, capacity)
    discard(edges)

    # units: a seed with what it took, or an item alone; the terms are those of the seed
    more = taken.groupBy(F.col("q").alias("doc_id")).agg(F.sum("size").alias("more"))
    alone = members.join(taken.select(F.col("n").alias("doc_id")), "doc_id", "left_anti")
    units = stored(alone.join(more, "doc_id", "left").select("doc_id", (F.col("n_tokens") + F.coalesce("more", F.lit(0))).cast("int").alias("n_tokens"), "leaf", "terms", "counts"))
    shape = "container_id string, place int, doc_id long, leaf int, n_tokens int, filled long, terms binary, counts binary"

    def shards(of: DataFrame, tag: str, most: int, apart: bool = False) -> DataFrame:
        """Packed in shards of neighbouring leaves, or each leaf apart; a shard above ``most`` items is split."""
        sizes = {r["leaf"]: r["count"] for r in of.groupBy("leaf").count().collect()}  # one row for each leaf, of which the sample bounds the number
        groups = len(tree.leaves) if apart else min(len(tree.leaves), max(1, -(-sum(sizes.values()) // most)))
        group = {leaf: leaf * groups // len(tree.leaves) for leaf in sizes}
        held = Counter()
        for leaf, n in sizes.items():
            held[group[leaf]] += n
        places = spark.createDataFrame([(leaf, g, -(-held[g] // most)) for leaf, g in group.items()], "leaf int, leaf_group int, parts int")
        split = of.join(F.broadcast(places), "leaf").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(tag)), F.col("parts")))
        return stored(split.groupBy("leaf_group", "part").applyInPandas(_packer(capacity, idf, mean, tag), shape))

    good = F.col("filled") >= FULL * capacity
    now = shards(units, "a", shard_items, apart=True)
    of = small.select("doc_id", "start_token", "n_tokens").join(taken.select(F.col("n").alias("doc_id"), "q", "score"), "doc_id", "left")
    # what a poor container of units holds is packed again item by item
    poor = materialise(of.select("doc_id", F.coalesce("q", "doc_id").alias("unit")).join(now.where(~good).select(F.col("doc_id").alias("unit")), "unit").select("doc_id"))
    packed = now.where(good)
    for number in range(1, AGAIN + 1):
        todo = stored(members.join(poor, "doc_id").select("doc_id", "n_tokens", "leaf", "terms", "counts")) if number == 1 else now.where(~good).select("doc_id", "n_tokens", "leaf", "terms", "counts")
        now = shards(todo, f"{chr(97 + number)}", shard_items * WIDER ** (number - 1))
        packed = packed.unionByName(now if number == AGAIN else now.where(good))
    packed = stored(packed.select("container_id", "place", F.col("doc_id").alias("unit")))
    discard(members)
    within = of.join(poor.withColumn("back", F.lit(True)), "doc_id", "left").withColumn("q", F.when(F.col("back").isNull(), F.col("q")))
    within = within.select(F.coalesce("q", "doc_id").alias("unit"), "doc_id", "start_token", "n_tokens", F.col("q").isNotNull().alias("under"), "score").join(packed, "unit")
    order = Window.partitionBy("container_id").orderBy("place", "under", F.desc("score"), "doc_id")
    names = [x.split()[0] for x in PACKED.split(", ")]
    return whole.unionByName(within.withColumn("item_pos", F.row_number().over(order) - 1).select(names))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "text")


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's place in a container."""
    return pack(_texts(spark, folder))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Number of containers and items, tokens held, and the share of unused space."""
    packed = pack(_texts(spark, folder))
    filled = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("filled"), F.count("*").alias("items"))
    return filled.agg(F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("filled").alias("n_tokens"), F.round(1 - F.sum("filled") / (F.count("*") * CAPACITY), 6).alias("unused_share"), F.max("filled").alias("most_filled"))


def p7_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the five best neighbours that retrieval reaches, for a bounded query set against brute force over all items."""
    items = _counted(_texts(spark, folder), tokens.VOCABULARY, CAPACITY)
    idf, mean, space, tree = indexed(items, SHARD_ITEMS)
    every = max(1, items.count() // 200)
    asked = items.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(every)) == 0).limit(400).select("doc_id", "terms").collect()
    exact = nearest(items, asked, space, tree, idf, mean)
    wanted = spark.createDataFrame([(r.doc_id,) for r in asked], "doc_id long").withColumn("seed", F.lit(True))
    all_items = items.join(F.broadcast(wanted), "doc_id", "left").select("doc_id", F.col("size").alias("n_tokens"), F.coalesce("seed", F.lit(False)).alias("seed"), "terms", "counts")
    members = stored(all_items.mapInArrow(_members(space, tree, idf, mean), f"doc_id long, {MEMBERS}, leaf int"))
    reached = searched(members, space, tree, idf, mean, VISITS, None, K).select("q", "n", F.lit(1).alias("hit"))
    met = exact.join(reached, ["q", "n"], "left").agg(F.countDistinct("q").alias("n_queries"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))
    return met.where("n_queries > 0").withColumn("leaves_visited", F.lit(min(VISITS, len(tree.leaves)))).withColumn("leaves", F.lit(len(tree.leaves)))


QUERIES = {"p7_recall": p7_recall, "p7_packed": p7_packed, "p7_report": p7_report}
