"""Approximate neighbours by an inverted file, for corpora that exact blocks are too costly for.

The vectors of a bounded sample give the centres of ``cells``; every vector is a member of the nearest, and a query visits
the cells nearest to it. How many it must visit is calibrated: a bounded set of the corpus' own vectors is compared with all
of it, and the fewest visits are taken that reach the wanted recall there. Work then grows with the members of the visited
cells instead of the whole corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.vectors import BLOCK, _nearest, nearest
from matchloom.session import materialise

#: Bounds: vectors that the centres are fitted to, vectors that the visits are calibrated on, and cells.
SAMPLE, CALIBRATION, MOST_CELLS = 20_000, 200, 1_024
CELL_ROWS, ROUNDS = 500, 8


def _units(column) -> np.ndarray:
    rows = np.array([np.asarray(x, dtype=np.float64) for x in column])
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def centres(sample: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """Unit centres of a spherical k-means; fewer than ``count`` if the sample has fewer vectors."""
    own = sample[np.random.default_rng(seed).permutation(len(sample))[:count]].copy()
    for _ in range(ROUNDS):
        near = (sample @ own.T).argmax(axis=1)
        sums = np.zeros_like(own)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        own = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), own)
    return own


@dataclass
class Inverted:
    """Centres, ``members(id, vector, cell)`` and the number of cells that a query visits."""

    centres: np.ndarray
    members: DataFrame
    visits: int


def _with_cells(centre: np.ndarray, key: str, visits: int | None):
    """Rows with their nearest cell, or with the ``visits`` nearest ones."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            near = _units(pdf.vector) @ centre.T
            cell = near.argmax(axis=1) if visits is None else list(np.argsort(-near, axis=1, kind="stable")[:, :visits])
            yield pd.DataFrame({key: pdf[key], "vector": pdf.vector, "cell": cell})

    return run


def inverted(corpus: DataFrame, n: int = 10, recall: float = 0.95) -> Inverted:
    """The inverted file of ``corpus(id, vector)``, calibrated for the ``n`` nearest; rows without vector stay out."""
    held = materialise(corpus.where("vector is not null").select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector")))
    total = held.count()
    share = min(1.0, 1.2 * SAMPLE / max(1, total))
    rows = held.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("vector").limit(SAMPLE).collect()
    sample = _units([r.vector for r in rows]) if rows else np.zeros((0, 1))
    if not len(sample):
        return Inverted(np.zeros((0, 1)), held.withColumn("cell", F.lit(0)), 1)
    centre = centres(sample, max(1, min(MOST_CELLS, len(sample), -(-total // CELL_ROWS))))
    members = materialise(held.mapInPandas(_with_cells(centre, "id", None), "id string, vector array<double>, cell int"))
    if len(centre) == 1:
        return Inverted(centre, members, 1)
    share = min(1.0, 1.2 * CALIBRATION / total)
    asked = materialise(held.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1_000_000)) < int(share * 1_000_000)).limit(CALIBRATION).withColumnRenamed("id", "qid"))
    true = nearest(asked, members, n).join(members.select("id", "cell"), "id").select("qid", "cell").collect()  # n rows for each of a bounded set
    order = {r.qid: {int(c): k for k, c in enumerate(np.argsort(-(_units([r.vector]) @ centre.T)[0], kind="stable"), 1)} for r in asked.collect()}
    needed = sorted(order[r.qid][r.cell] for r in true)
    return Inverted(centre, members, needed[int(np.ceil(recall * len(needed))) - 1] if needed else len(centre))


def approximately_nearest(queries: DataFrame, index: Inverted, n: int) -> DataFrame:
    """``(qid, id, distance, place)``: the n nearest members for each of ``queries(qid, vector)`` in the cells that it visits.

    Cells and the queries that visit them are cut into blocks of ``BLOCK``, so that no task holds a hot cell whole.
    """
    if not len(index.centres):
        return queries.sparkSession.createDataFrame([], "qid string, id string, distance double, place int")
    asked = queries.where("vector is not null").select(F.col("qid").cast("string").alias("qid"), F.col("vector").cast("array<double>").alias("vector"))
    asked = asked.mapInPandas(_with_cells(index.centres, "qid", index.visits), "qid string, vector array<double>, cell array<int>")
    asked = materialise(asked.select("qid", "vector", F.explode("cell").alias("cell")))
    blocks = lambda rows, name: rows.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias(name))
    sizes = F.broadcast(materialise(blocks(index.members, "nm").join(blocks(asked, "nq"), "cell")))  # at most MOST_CELLS rows
    spread = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    own = lambda key, name: F.pmod(F.xxhash64(key), F.col(name)).cast("int")
    asks = asked.join(sizes, "cell").select("cell", F.col("qid").alias("key"), "vector", F.lit(True).alias("asks"), own("qid", "nq").alias("qb"), spread("nm").alias("cb"))
    holds = index.members.join(sizes, "cell").select("cell", F.col("id").alias("key"), "vector", F.lit(False).alias("asks"), spread("nq").alias("qb"), own("id", "nm").alias("cb"))
    met = asks.unionByName(holds).groupBy("cell", "qb", "cb").applyInPandas(_nearest(n), "qid string, id string, distance double")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return met.withColumn("place", place).where(F.col("place") <= n)
