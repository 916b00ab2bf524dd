"""Representative vectors of a profile by k-means, and by given labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.config import DEFAULTS
from matchloom.functions.vectors import doubles


def kmeans(data: np.ndarray, k: int, rounds: int = 100, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and labels by Lloyd's rounds from a seeded choice of rows; an empty cluster keeps its centroid."""
    if k >= len(data):
        return data.copy(), np.arange(len(data))
    centres = data[np.random.RandomState(seed).choice(len(data), k, replace=False)].astype(float)
    for _ in range(rounds):
        far = np.linalg.norm(data[:, None, :] - centres[None, :, :], axis=2)
        labels = far.argmin(axis=1)
        moved = np.array([data[labels == j].mean(axis=0) if (labels == j).any() else centres[j] for j in range(k)])
        if np.allclose(centres, moved):
            break
        centres = moved
    return centres, labels


def representatives(chunks: DataFrame, k: int = DEFAULTS.representatives) -> DataFrame:
    """``(owner, place, chunk_index)`` of the chunk nearest to each centroid of ``chunks(owner, chunk_index, vector)``.

    One owner's chunks meet in one task: an owner is one document, whose length bounds them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_index", ignore_index=True)
        data = np.array([np.asarray(x, float) for x in pdf.vector])
        n = min(k, len(data))
        centres, labels = kmeans(data, n)
        found = []
        for j in range(n):
            own = np.flatnonzero(labels == j)
            if len(own):
                found.append(int(pdf.chunk_index[own[np.linalg.norm(data[own] - centres[j], axis=1).argmin()]]))
        return pd.DataFrame({"owner": [pdf.owner[0]] * len(found), "place": range(len(found)), "chunk_index": found})

    return chunks.where("vector is not null").groupBy("owner").applyInPandas(run, "owner string, place int, chunk_index int")


def representatives_of_labels(rows: DataFrame) -> DataFrame:
    """``(label, id, distance)``: the row of ``rows(id, label, vector)`` nearest to the mean of its label; ties to the lower id."""
    parts = rows.select("id", "label", F.posexplode(doubles(F.col("vector"))).alias("at", "value"))
    centre = parts.groupBy("label", "at").agg(F.avg("value").alias("centre"))
    far = parts.join(centre, ["label", "at"]).groupBy("label", "id").agg(F.round(F.sqrt(F.sum((F.col("value") - F.col("centre")) * (F.col("value") - F.col("centre")))), 9).alias("distance"))
    return far.groupBy("label").agg(F.min(F.struct("distance", "id")).alias("m")).select("label", "m.id", "m.distance")
