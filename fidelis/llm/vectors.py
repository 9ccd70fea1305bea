"""Rows of vectors: which take part, copies, and blocks that a worker reads one after another."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid(df: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """id, v (array of double): rows with an id and a vector of finite components, of the commonest length
    (ties: the longest); zero=False leaves zero vectors out. Empty vectors never take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & (~F.isnan(x)) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    if not zero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    rows = rows.select(F.col(key).cast("long").alias("id"), v.alias("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (lengths[0].d if lengths else 0))


def firsts(rows: DataFrame, k: int) -> DataFrame:
    """Of every group of equal vectors the k smallest ids: no search needs more candidates."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return rows.dropDuplicates(["id", "v"]).withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0), dtype=kind)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Slices of the batches, by runs of equal first columns."""

    def slices():
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
            change = np.zeros(batch.num_rows - 1, bool)
            for c in cols:
                change |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in itertools.pairwise(cuts):
                yield tuple(int(c[a]) for c in cols), batch.slice(a, b - a)

    for key, run in itertools.groupby(slices(), key=lambda x: x[0]):
        yield key, (s for _, s in run)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row by row the k largest scores, ties to smaller ids."""
    if scores.shape[1] > 4 * k:
        # only scores that reach the kth of their row are sorted; ties at the edge all stay until then
        edge = np.partition(scores, -k, axis=1)[:, -k]
        r, c = np.nonzero(scores >= edge[:, None])
        picked, named = scores[r, c], ids[r, c]
        order = np.lexsort((named, -picked, r))
        r = r[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        first = order[place < k]
        return picked[first].reshape(-1, k), named[first].reshape(-1, k)
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def ranked(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """found: q (number of a distinct query vector), vec_id, score; queries: id, q. Each query's k best others."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    # one more than k, as a query's own row may be among them
    top = found.dropDuplicates(["q", "vec_id"]).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1).drop("_n")
    mine = queries.join(top, "q").where("id <> vec_id")
    w = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    rank = mine.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return rank.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
