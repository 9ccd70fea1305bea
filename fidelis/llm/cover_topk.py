"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integer rows floor(scale * x). Cells around pivots (more for more rows) form the upper level: each
cell's centre and covering radius are exact over all rows. Data and queries of a cell are cut into blocks, and a
worker builds a cover tree over a data block and one over each group of queries that it meets. Node pairs are
taken best bound first and pruned when the smaller of two bounds stays below the worst kth score in the query node:

    <p, q> + radius_q |p| + radius_p |q| + radius_p radius_q        (both balls)
    |p'| |q'| cos(angle(p, q) - width_p - width_q)                  (both cones, by the nodes' norms)

A query leaf goes on alone, with <p, q> + radius_p |q| for each of its queries against that query's own kth score.
A first pass searches each query cell's most promising data cell; its worst kth scores prune whole cell pairs before
the second pass, and start its traversals.

Of equal vectors only the first k + 1 ids are candidates and equal queries search once, which loses nothing.
Defined results: null or non-finite vectors, null ids and vectors of another length than the commonest take
no part (zero vectors do); ties go to the smaller id; fewer than k candidates give fewer rows; repeated rows
count once; extra columns stay out.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.llm._util import written
from fidelis.llm.vectors import best, firsts, groups, matrix, ranked, valid

#: Cells at least and at most (one for CELL rows between), rows that pivots are chosen from, rows of a data block, points
#: of a leaf, those that make no leaf of their own, points of a node that pairs of nodes go down to, the base of the levels.
CELLS, MOST, CELL, SAMPLE, BLOCK, LEAF, FEW, COARSE, BASE = 24, 256, 4096, 4000, 8192, 64, 16, 1024, 1.3
#: Slack of bounds for rounding, in parts of the bound's terms.
ROUND = 1e-9


def pivots(x: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Farthest-first points of the sample."""
    if not len(x):
        return np.zeros((0, 0))
    picked, gap = [0], ((x - x[0]) ** 2).sum(1)
    while len(picked) < min(cells, len(x)) and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[picked[-1]]) ** 2).sum(1))
    return x[picked]


class CoverTree:
    """Nodes are (centre row, covering radius, children, rows); children cover their parent's rows within a
    radius smaller by BASE, their centres lie farther apart than that, and the first keeps the parent's centre."""

    def __init__(self, x: np.ndarray):
        self.x, self.norm = x, np.sqrt((x * x).sum(1))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.width: list[float] = []
        self.least: list[float] = []
        self.most: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        if len(x):
            todo = [(self._node(0, np.arange(len(x))))]
            while todo:
                todo += self._split(todo.pop())

    def _node(self, centre: int, rows: np.ndarray) -> int:
        gap, norm = self.x[rows] - self.x[centre], self.norm[rows]
        self.centre.append(centre)
        self.radius.append(float(np.sqrt((gap * gap).sum(1).max())))
        size = norm * self.norm[centre]
        cos = np.where(size > 0, self.x[rows] @ self.x[centre] / np.where(size > 0, size, 1), -1)
        self.width.append(float(np.arccos(np.clip(cos.min(), -1, 1))) + 1e-7)
        self.least.append(float(norm.min()))
        self.most.append(float(norm.max()))
        self.children.append([])
        self.rows.append(rows)
        return len(self.centre) - 1

    def _net(self, rows: np.ndarray, centre: int, reach: float) -> list[tuple[int, np.ndarray]]:
        """Centres in order of the rows, the given one first, each with the rows left that it covers."""
        out, left = [], np.r_[centre, rows[rows != centre]]
        while len(left):
            some = left[:LEAF]
            a, b = self.x[some], self.x[left]
            near = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None] <= reach * reach
            free = np.ones(len(left), bool)
            for i in range(len(some)):
                if free[i]:
                    mine = near[i] & free
                    mine[i] = True
                    out.append((int(some[i]), left[mine]))
                    free &= ~mine
            left = left[free]
        return out

    def _split(self, node: int) -> list[int]:
        rows = self.rows[node]
        if len(rows) <= LEAF or self.radius[node] == 0:
            return []
        net = self._net(rows, self.centre[node], self.radius[node] / BASE)
        # centres that cover few rows share leaves
        parts = [p for p in net if len(p[1]) >= FEW]
        few = np.concatenate([np.zeros(0, np.int64), *(r for _, r in net if len(r) < FEW)])
        parts += [(int(few[at]), few[at : at + LEAF]) for at in range(0, len(few), LEAF)]
        if len(parts) == 1:
            return []
        self.children[node] = [self._node(c, r) for c, r in parts]
        return [c for c in self.children[node] if len(self.rows[c]) < len(rows)]


def dual(queries: CoverTree, data: CoverTree, ids: np.ndarray, score: np.ndarray, found: np.ndarray, floor: np.ndarray) -> int:
    """Raises score and found (rows of queries by k, best first) by the data; floor: scores that count already.
    Returns how many products of a query and a vector were made."""
    k, made = score.shape[1], 0
    exact = np.abs(queries.x).max(initial=0) * np.abs(data.x).max(initial=0) * queries.x.shape[1] < 2**53
    ints = None if exact else (queries.x.astype(np.int64), data.x.astype(np.int64))

    def bound(q: int, d: int) -> float:
        cq, cd = queries.centre[q], data.centre[d]
        rq, rd, nq, nd = queries.radius[q], data.radius[d], queries.norm[cq], data.norm[cd]
        product = float(queries.x[cq] @ data.x[cd])
        balls = product + rq * nd + rd * nq + rq * rd
        size, angle = nq * nd, 0.0
        if size > 0:
            angle = float(np.arccos(np.clip(product / size, -1, 1))) - queries.width[q] - data.width[d]
        cos = float(np.cos(angle)) if 0 < angle < np.pi else 1.0 if angle <= 0 else -1.0
        cones = cos * (queries.most[q] * data.most[d] if cos > 0 else queries.least[q] * data.least[d])
        return min(balls, cones) + (abs(balls) + nq * nd + queries.most[q] * data.most[d]) * ROUND + ROUND

    def worst(rows: np.ndarray) -> np.ndarray:
        return np.maximum(score[rows, k - 1], floor[rows])

    def leaf(q: int, top: int) -> None:
        """All that the queries of a leaf can find under a data node, most promising first."""
        nonlocal made
        rows = queries.rows[q]
        x, norm, stack = queries.x[rows], queries.norm[rows], [(top, np.ones(len(rows), bool))]
        while stack:
            d, live = stack.pop()
            kids = data.children[d]
            if kids:
                centres, radius = [data.centre[c] for c in kids], np.array([data.radius[c] for c in kids])
                reach = (data.x[centres] @ x.T) + radius[:, None] * norm
                reach += (np.abs(reach) + data.norm[centres][:, None] * norm) * ROUND + ROUND
                fits = (reach >= worst(rows)) & live
                for i in np.argsort(np.where(fits, reach, -np.inf).max(1), kind="stable").tolist():
                    if fits[i].any():
                        stack.append((kids[i], fits[i]))
                continue
            # its kth scores may have risen since it was put aside
            cd, low = data.centre[d], worst(rows)
            reach = x @ data.x[cd] + data.radius[d] * norm
            live = np.flatnonzero(live & (reach + (np.abs(reach) + data.norm[cd] * norm) * ROUND + ROUND >= low))
            for at in range(0, len(data.rows[d]) if len(live) else 0, 1024):
                r, c = rows[live], data.rows[d][at : at + 1024]
                got = queries.x[r] @ data.x[c].T if exact else (ints[0][r] @ ints[1][c].T).astype(np.float64)
                made += got.size
                up = got.max(1) >= worst(r)
                r, got = r[up], got[up]
                if len(r):
                    score[r], found[r] = best(np.c_[score[r], got], np.c_[found[r], np.broadcast_to(ids[c], got.shape)], k)

    order = itertools.count()
    heap = [(-bound(0, 0), next(order), 0, 0)]
    while heap:
        top, _, q, d = heapq.heappop(heap)
        if -top < worst(queries.rows[q]).min():
            continue
        split_q, split_d = queries.children[q], data.children[d] if len(data.rows[d]) > COARSE else []
        if not split_q and not split_d:
            leaf(q, d)
            continue
        pairs = [(c, d) for c in split_q] if split_q and (not split_d or queries.radius[q] >= data.radius[d]) else [(q, c) for c in split_d]
        for a, b in pairs:
            value = bound(a, b)
            if value >= worst(queries.rows[a]).min():
                heapq.heappush(heap, (-value, next(order), a, b))
    return made


def search(df: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long): each query row's k largest inner products, all others searched."""
    spark = df.sparkSession
    rows = valid(df, key, vector, zero=True).select("id", F.transform("v", lambda x: F.floor(F.lit(scale) * x)).alias("v"))
    index = written(firsts(rows, k + 1), "points")
    base, n = 1 << 30, index.count()
    share = base if not n else min(base, base * SAMPLE // n)
    drawn = index.where(F.pmod(F.xxhash64(F.col("id"), F.lit("cover")), F.lit(base)) < share).orderBy("id").collect()
    cells = min(MOST, max(CELLS, n // CELL))
    centres = pivots(np.array([r.v for r in drawn], np.float64), cells) if drawn else np.zeros((0, 0))
    sent = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = matrix(part.column(1))
                if len(p):
                    far = (x * x).sum(1)[:, None] - 2 * (x @ p.T) + (p * p).sum(1)[None]
                    cell = far.argmin(1)
                    gap = np.sqrt(((x - p[cell]) ** 2).sum(1))
                else:
                    cell, gap = np.zeros(len(x), np.int64), np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(gap), *part.columns], names=["cell", "gap", "id", "v"])

    schema = "cell bigint, gap double, id bigint, v array<bigint>"
    placed = written(index.select("id", "v").mapInArrow(place, schema), "cells")
    asked = rows.where(queries)
    numbered = written(asked.groupBy("v").agg(F.min("id").alias("id")).select("id", "v").mapInArrow(place, schema), "queries")
    # a row for each cell: at most MOST
    own = {r.cell: r for r in placed.groupBy("cell").agg(F.max("gap").alias("gap"), F.count(F.lit(1)).alias("n")).collect()}
    ask = {r.cell: r for r in numbered.groupBy("cell").agg(F.max("gap").alias("gap")).collect()}

    def bound(q: int, d: int) -> float:
        cq, cd, rq, rd = centres[q], centres[d], ask[q].gap, own[d].gap
        nq, nd = np.linalg.norm(cq), np.linalg.norm(cd)
        return float(cq @ cd + (rq * nd + rd * nq + rq * rd) * (1 + 1e-6) + 1e-6 * nq * nd + 1e-6)

    def run(pairs: list[tuple[int, int]], start: DataFrame) -> DataFrame:
        """q, vec_id, score from the pairs of cells; start: id, floor."""
        plan = spark.createDataFrame([(q, d, b) for q, d in pairs for b in range(-(-own[d].n // BLOCK))] or [(-1, -1, -1)], "cell bigint, data bigint, block bigint")
        blocks = spark.createDataFrame([(c, -(-r.n // BLOCK)) for c, r in own.items()] or [(-1, 1)], "cell bigint, blocks bigint")
        used = sorted({d for _, d in pairs})
        left = placed.where(F.col("cell").isin(used or [-1])).join(F.broadcast(blocks), "cell").select(F.col("cell").alias("data"), F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.lit(-1).cast("long").alias("cell"), "id", F.lit(0.0).alias("floor"), "v")
        right = numbered.join(start, "id", "left").join(F.broadcast(plan), "cell").select("data", "block", "cell", "id", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "v")

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def answered(tree, ids, some):
                q, floor, x = some.column(3).to_numpy(), some.column(4).to_numpy(), matrix(some.column(5))
                score, found = np.full((len(q), k + 1), -np.inf), np.full((len(q), k + 1), np.iinfo(np.int64).max)
                dual(CoverTree(x), tree, ids, score, found, floor)
                r, c = np.nonzero(np.isfinite(score))
                return pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(found[r, c]), pa.array(score[r, c].astype(np.int64))], names=["q", "vec_id", "score"])

            for _, parts in groups(batches, 2):
                ids, data, tree = [], [], None
                for part in parts:
                    for (_, _, cell), some in groups(iter([part]), 3):
                        for s in some:
                            if cell < 0:
                                ids.append(s.column(3).to_numpy())
                                data.append(matrix(s.column(5)))
                                continue
                            if not ids:
                                continue
                            if tree is None:
                                known = np.concatenate(ids)
                                tree = CoverTree(np.concatenate(data))
                            for at in range(0, s.num_rows, 1024):
                                yield answered(tree, known, s.slice(at, 1024))

        dealt = left.unionByName(right).repartition("data", "block").sortWithinPartitions("data", "block", "cell")
        return dealt.mapInArrow(walk, "q bigint, vec_id bigint, score bigint")

    none = spark.createDataFrame([], "id bigint, floor double")
    first = [(q, max(own, key=lambda d: (own[d].n > k, float(centres[q] @ centres[d]), -d))) for q in ask] if own else []
    met = written(run(first, none), "first")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    kth = met.withColumn("n", F.row_number().over(w)).where(F.col("n") == k + 1).select(F.col("q").alias("id"), F.col("score").cast("double").alias("floor"))
    kth = written(kth, "floors")
    lows = {r.cell: r for r in numbered.join(kth, "id", "left").groupBy("cell").agg(F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("low")).collect()}
    second = [(q, d) for q in ask for d in own if (q, d) not in set(first) and bound(q, d) >= lows[q].low]
    found = met.unionByName(run(second, kth))
    names = asked.join(numbered.select(F.col("id").alias("q"), "v"), "v").select("id", "q").distinct()
    return ranked(found, names, k)
