"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on at most about `SAMPLE` vectors (by hash of the id); every vector is indexed in the
leaf it descends to. A query walks the tree with a priority queue, nearest centre first, and visits leaves
until the number that calibration found: on sample queries, visits are widened until the true neighbours
within the sample are met at `TARGET` recall. Leaves are cut into blocks, so a leaf of any size is scanned
by many tasks; scores are exact double cosines of the original vectors.

Of equal vectors only the first k + 1 ids are candidates and equal queries search once: this loses nothing
and keeps groups of copies cheap. Defined results: null, zero or non-finite vectors, null ids and vectors
of another length than the commonest take no part; ties go to the smaller id; fewer than k candidates give
fewer rows; repeated rows count once; extra columns stay out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.llm._util import written
from fidelis.llm.vectors import firsts, groups, matrix, ranked, valid

#: Vectors that the tree is fitted on, children of a node, sample vectors of a leaf, recall to calibrate to,
#: sample queries that it is measured on, rows of a block.
SAMPLE, BRANCH, LEAF, TARGET, PROBES, BLOCK = 20_000, 8, 48, 0.975, 300, 2048


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


class Tree:
    """centres of all nodes, their children (empty: a leaf)."""

    def __init__(self, centres: np.ndarray, children: list[list[int]]):
        self.centres, self.children = centres, children

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 11) -> Tree:
        rng, centres, children = np.random.default_rng(seed), [x.mean(0) if len(x) else np.zeros(0)], [[]]
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= LEAF:
                continue
            own = x[rows]
            c = own[rng.choice(len(rows), min(BRANCH, len(rows)), replace=False)]
            for _ in range(12):
                near = (own @ c.T).argmax(1)
                sums = np.array([own[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))])
                c = unit(sums)
            near = (own @ c.T).argmax(1)
            filled = [i for i in range(len(c)) if (near == i).any()]
            if len(filled) < 2:
                continue
            for i in filled:
                children[node].append(len(centres))
                todo.append((len(centres), rows[near == i]))
                centres.append(c[i])
                children.append([])
        return cls(np.array(centres), children)

    def leaves(self) -> int:
        return sum(not c for c in self.children)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row descends to."""
        at, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids or not len(rows):
                at[rows] = node
                continue
            near = (x[rows] @ self.centres[kids].T).argmax(1)
            todo += [(kid, rows[near == i]) for i, kid in enumerate(kids)]
        return at

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        queue = [(-1.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                yield node
                continue
            for kid, near in zip(kids, (self.centres[kids] @ q).tolist(), strict=True):
                heapq.heappush(queue, (-near, kid))


def calibrate(tree: Tree, x: np.ndarray, k: int, seed: int = 5) -> int:
    """Leaves to visit so that sample queries meet TARGET of their true neighbours in the sample."""
    if len(x) < 2 or tree.leaves() < 2:
        return 1
    rng = np.random.default_rng(seed)
    picks = rng.choice(len(x), min(PROBES, len(x)), replace=False)
    leaf, total = tree.assign(x), tree.leaves()
    met, wanted = np.zeros(total + 1), 0
    for i in picks:
        near = x @ x[i]
        near[i] = -2
        true = np.argsort(-near, kind="stable")[:k]
        order = {node: place for place, node in enumerate(tree.visit(x[i]))}
        for t in true:
            met[order[leaf[t]] + 1] += 1
            wanted += 1
    enough = np.flatnonzero(np.cumsum(met) >= TARGET * wanted)
    return int(max(1, enough[0]))


def search(df: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k nearest found, by cosine."""
    spark = df.sparkSession
    rows = valid(df, key, vector, zero=False)
    index = written(firsts(rows, k + 1), "index")
    base = 1 << 30
    n = index.count()
    share = base if not n else min(base, base * SAMPLE // n)
    drawn = index.where(F.pmod(F.xxhash64(F.col("id"), F.lit("ann")), F.lit(base)) < share).orderBy("id").collect()
    sample = unit(np.array([r.v for r in drawn], np.float64)) if drawn else np.zeros((0, 1))
    tree = Tree.fit(sample)
    visits = calibrate(tree, sample, k)
    sent = spark.sparkContext.broadcast((tree.centres, tree.children, visits))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tree(*sent.value[:2])
        for batch in batches:
            leaf = own.assign(unit(matrix(batch.column(1))))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", "id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, most = Tree(*sent.value[:2]), sent.value[2]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [[leaf for leaf, _ in zip(own.visit(q), range(most), strict=False)] for q in unit(matrix(part.column(1)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int64()))], names=["q", "v", "leaves"])

    placed = written(index.mapInArrow(assign, "leaf bigint, id bigint, v array<double>"), "leaves")
    # one row for each leaf, and there are at most as many leaves as sample vectors
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    asked = rows.where(queries).select("id", "v")
    # equal query vectors search once, under the smallest of their ids
    numbered = written(asked.groupBy("v").agg(F.min("id").alias("q")), "queries")
    probes = numbered.select("q", "v").mapInArrow(probe, "q bigint, v array<double>, leaves array<bigint>")
    left = placed.join(F.broadcast(sizes), "leaf").select("leaf", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.lit(0).alias("kind"), "id", "v")
    right = probes.select("q", "v", F.explode("leaves").alias("leaf")).join(F.broadcast(sizes), "leaf")
    right = right.select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), F.col("q").alias("id"), "v")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in groups(batches, 2):
            ids, data = [], []
            have = None
            for part in parts:
                for (kind,), some in groups(iter([part.select([2, 3, 4])]), 1):
                    for s in some:
                        if kind == 0:
                            ids.append(s.column(1).to_numpy())
                            data.append(matrix(s.column(2)))
                            continue
                        if not ids:
                            continue
                        if have is None:
                            have = np.concatenate(ids), np.concatenate(data)
                            near = unit(have[1])
                        for at in range(0, s.num_rows, 512):
                            q = s.slice(at, 512)
                            x = matrix(q.column(2))
                            close = unit(x) @ near.T
                            take = min(k + 1, len(have[0]))
                            edge = np.partition(close, -take, 1)[:, -take] - 1e-9
                            r, c = np.nonzero(close >= edge[:, None])
                            # products of equal rows are summed alike wherever they stand, so that ties are ties
                            a, b = x[r], have[1][c]
                            a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
                            score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
                            vec = have[0][c]
                            order = np.lexsort((vec, -score, r))
                            r, vec, score = r[order], vec[order], score[order]
                            first = np.r_[True, r[1:] != r[:-1]]
                            place = np.arange(len(r)) - np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
                            keep = place < k + 1
                            yield pa.RecordBatch.from_arrays([pa.array(q.column(1).to_numpy()[r[keep]]), pa.array(vec[keep]), pa.array(score[keep])], names=["q", "vec_id", "score"])

    dealt = left.unionByName(right).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind")
    found = dealt.mapInArrow(scan, "q bigint, vec_id bigint, score double")
    names = asked.join(numbered, "v").select("id", "q").distinct()
    return ranked(found, names, k)
