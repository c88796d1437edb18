"""Nearest neighbours of a stated query set: queries go to all tasks in blocks, each task keeps its k best, a merge keeps the k best of all."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block.
BLOCK = 1024


def nearest(queries: DataFrame, rows: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", most_queries: int = 200_000) -> DataFrame:
    """(query, id, label, distance, place): for each query its k nearest other rows by Euclidean distance, ties by id.

    The query set is sent to the tasks, in parts of about ``most_queries`` by the hash of their ids: each part is a pass over the rows.
    """
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    parts = max(1, -(-asked.count() // most_queries))
    flat = rows.select(F.col(id_col).cast("long"), F.col(label).cast("long"), F.col(vector).cast("array<double>"))
    found = [_nearest_of(asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i) if parts > 1 else asked, flat, k) for i in range(parts)]
    w = Window.partitionBy("query").orderBy("distance", "id")
    return reduce(DataFrame.unionAll, found).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _nearest_of(queries: DataFrame, flat: DataFrame, k: int) -> DataFrame:
    """(query, id, label, distance): each task's k nearest rows for each of one part of the queries."""
    got = queries.toArrow()
    ids = got.column(0).to_numpy()
    asked = got.column(1).combine_chunks().flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.empty((0, 0))
    sent = flat.sparkSession.sparkContext.broadcast((ids, asked))

    def run(batches):
        own, points = sent.value
        best: list = [None] * -(-len(own) // BLOCK)
        for batch in batches:
            if not batch.num_rows or not len(own):
                continue
            name = batch.column(0).to_numpy()
            kind = batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            for b in range(len(best)):
                part = slice(b * BLOCK, (b + 1) * BLOCK)
                d = ((points[part, None, :] - x[None, :, :]) ** 2).sum(-1) if x.shape[1] * len(x) * BLOCK < 2**24 else np.maximum(0, (points[part] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * points[part] @ x.T)
                d[own[part][:, None] == name] = np.inf
                names, kinds = np.broadcast_to(name, d.shape), np.broadcast_to(kind, d.shape)
                if best[b] is not None:
                    d, names, kinds = (np.concatenate(z, 1) for z in zip(best[b], (d, names, kinds)))
                order = np.lexsort((names, d))[:, :k]
                best[b] = tuple(np.take_along_axis(z, order, 1) for z in (d, names, kinds))
        for b, found in enumerate(best):
            if found is not None:
                d, names, kinds = found
                keep = np.isfinite(d).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[b * BLOCK : (b + 1) * BLOCK], d.shape[1])[keep]), pa.array(names.ravel()[keep]), pa.array(kinds.ravel()[keep]), pa.array(np.sqrt(d).ravel()[keep])], ["query", "id", "label", "distance"])

    return flat.mapInArrow(run, "query long, id long, label long, distance double")


def vote(neighbours: DataFrame) -> DataFrame:
    """(query, label): the label of the largest sum of inverse distances, ties to the lower label."""
    weight = neighbours.groupBy("query", "label").agg(F.sum(1.0 / F.greatest(F.col("distance"), F.lit(1e-12))).alias("w"))
    return weight.groupBy("query").agg((-F.max(F.struct("w", (-F.col("label")).alias("l")))["l"]).alias("label"))
