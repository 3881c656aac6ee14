"""Exact top-k by inner product with dual cover trees.

Candidates and queries are dealt in blocks; each task builds a cover tree over its candidates, each query block one
over its queries, and both are walked together. A pair of nodes is pruned when its bound, from the two centres, their
norms and covering radii, is below the worst kth score of the query node's group. A task's answers, k a query, are
merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ship

#: Rows under which a node is scanned; candidates of a tree; queries sent at once.
LEAF, TREE, QUERIES = 64, 8_192, 16_384
#: A level's covering radius over that of the next.
RATIO = 1.3
#: Doubles hold every integer up to this.
EXACT = 1 << 53
#: What a task answers: the query's number, id, copies and product with itself, and a candidate with its score.
FOUND = ["query", "query_id", "times", "own", "vec_id", "score"]


@dataclass
class Node:
    """Rows ``lo`` to ``hi`` of the tree's order, all within ``radius`` of ``centre``."""

    centre: np.ndarray
    norm: float
    radius: float
    lo: int
    hi: int
    children: list["Node"]


def cover_tree(points: np.ndarray, leaf: int = LEAF, most: float = 1 / 8) -> tuple[Node, np.ndarray]:
    """A cover tree, by levels of shrinking covering radius, and the order of its rows.

    A node's centre is one of its points; its children's centres are chosen greedily further than the next radius
    apart, the node's own centre first, and each point goes to the first centre within that radius. A node whose
    children would be more than a share ``most`` of its points has no cover to speak of and stays one scanned node.
    """
    order = np.arange(len(points))

    def build(lo: int, hi: int) -> Node:
        own = order[lo:hi]
        centre = points[own[0]]
        away = np.sqrt(((points[own] - centre) ** 2).sum(1))
        radius = float(away.max())
        node = Node(centre, float(np.sqrt((centre**2).sum())), radius, lo, hi, [])
        if hi - lo <= leaf or radius == 0:
            return node
        inner = radius / RATIO
        parts, left, near = [], own, away <= inner
        while True:
            parts.append(left[near])
            left = left[~near]
            if not len(left):
                break
            near = ((points[left] - points[left[0]]) ** 2).sum(1) <= inner * inner
            if len(parts) > len(own) * most:
                return node
        at = lo
        for p in parts:
            order[at : at + len(p)] = p
            at += len(p)
        at = lo
        for p in parts:
            node.children.append(build(at, at + len(p)))
            at += len(p)
        return node

    return build(0, len(points)), order


def query_tree(queries: np.ndarray) -> tuple[Node, np.ndarray]:
    """A tree of small query groups: a group's radius loosens every bound, so it is kept small."""
    return cover_tree(queries, 4, 1 / 2)


class Best:
    """The k best of each query: scores descending, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.taken = np.zeros((n, 1), np.int64)

    def found(self) -> np.ndarray:
        """Which places are taken."""
        return self.taken > np.arange(self.k)

    def worst(self, lo: int, hi: int) -> int:
        return int(self.score[lo:hi, -1].min())

    def add(self, lo: int, hi: int, scores: np.ndarray, ids: np.ndarray, own: np.ndarray | None) -> None:
        """``scores``: queries lo to hi by candidates; a candidate with the query's own id, if told, doesn't count."""
        good = scores >= self.score[lo:hi, -1:]
        if own is not None:
            good &= ids[None, :] != own[lo:hi, None]
        for i in np.flatnonzero(good.any(1)):
            s, d = scores[i, good[i]], ids[good[i]]
            s, d = np.concatenate([self.score[lo + i], s]), np.concatenate([self.id[lo + i], d])
            first = np.lexsort((d, ~s))[: self.k]  # ~s falls as s grows, without overflow
            self.score[lo + i], self.id[lo + i] = s[first], d[first]
            self.taken[lo + i] = min(self.k, self.taken[lo + i, 0] + good[i].sum())


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating matrix product where doubles hold them, else in 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def dual_search(queries: np.ndarray, query_ids: np.ndarray | None, qtree: tuple[Node, np.ndarray], points: np.ndarray, ids: np.ndarray, k: int) -> tuple[Best, int]:
    """The k best candidates of each query (in the query tree's order), and how many scores were computed."""
    xroot, xorder = cover_tree(points)
    qroot, qorder = qtree
    q, own, x, xid = queries[qorder], None if query_ids is None else query_ids[qorder], points[xorder], ids[xorder]
    best, done = Best(len(q), k), 0

    def bound(a: Node, b: Node) -> float:
        v = float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
        return v + abs(v) * 1e-9 + 1e-6  # rounding must not prune

    stack = [(bound(qroot, xroot), qroot, xroot)]
    while stack:
        v, a, b = stack.pop()
        if v < best.worst(a.lo, a.hi):
            continue
        if not a.children and not b.children:
            for lo in range(a.lo, a.hi, 512):
                hi = min(a.hi, lo + 512)
                best.add(lo, hi, dots(q[lo:hi], x[b.lo : b.hi]), xid[b.lo : b.hi], own)
            done += (a.hi - a.lo) * (b.hi - b.lo)
            continue
        if b.children and (not a.children or b.radius >= a.radius):
            pairs = [(bound(a, c), a, c) for c in b.children]
        else:
            pairs = [(bound(c, b), c, b) for c in a.children]
        stack += sorted(pairs, key=lambda p: p[0])  # the best bound is walked first
    return best, done


def as_matrix(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def quantised(vectors: DataFrame, vec_id: Column, vector: Column) -> DataFrame:
    """``vec_id``, ``v``: components times 1024, rounded down. Null ids, null vectors, and vectors with null or
    non-finite components take no part."""
    v = F.col("v")
    return (
        vectors.select(vec_id.cast("bigint").alias("vec_id"), vector.cast("array<double>").alias("v"))
        .where(v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
        .select("vec_id", F.transform(v, lambda x: F.floor(x * 1024.0)).alias("v"))
    )


def top_k(vectors: DataFrame, vec_id: Column, vector: Column, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's k highest inner products among all rows
    but its own, all if there are fewer; ties to the smaller id. ``is_query`` tells from ``vec_id`` who asks.

    Every row is compared, none capped. Each row of a repeated id asks for itself, and the others of that id are
    candidates; rows equal in id and vector are searched for once and answered as often as they stand. To leave out
    one row alone, k + 1 are searched for: if the query's own is among them, one of its id and score goes.
    A shorter vector counts as padded with zeros. Empty tables give no rows. Queries go to the executors
    ``QUERIES`` at a time, fetched by partition, whatever their number; scores past 64 bits wrap.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = quantised(vectors, vec_id, vector)
    asking = rows.where(is_query).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times"))
    trees = max(1, -(-rows.count() // TREE))
    dealt = rows.repartition(trees)
    found: DataFrame | None = None
    for at, block in enumerate(_blocks(asking)):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent, base=at * QUERIES) -> Iterator[pa.RecordBatch]:
            qids, qrows, times = sent.value
            qwidth = max((len(r) for r in qrows), default=0)
            qtree = None
            held: list[pa.RecordBatch] = []
            n = 0

            def answer() -> Iterator[pa.RecordBatch]:
                nonlocal qtree
                ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
                listed = [r for b in held for r in b.column(1).to_pylist()]
                width = max(qwidth, max(map(len, listed)))
                q = as_matrix(qrows, width)
                qtree = qtree or query_tree(q)
                x = as_matrix(listed, width)
                if qtree[0].centre.shape[0] != width:
                    qtree = query_tree(q)
                best, _ = dual_search(q, None, qtree, x, ids, k + 1)
                slot, there = np.nonzero(best.found())
                who = qtree[1][slot]
                own = (q.astype(np.int64) ** 2).sum(1)
                found = [base + who, qids[who], times[who], own[who], best.id[slot, there], best.score[slot, there]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], FOUND)

            for batch in batches:
                for at in range(0, batch.num_rows, TREE):
                    held.append(batch.slice(at, TREE))
                    n += held[-1].num_rows
                    if n >= TREE:
                        yield from answer()
                        held, n = [], 0
            if n:
                yield from answer()

        part = dealt.mapInArrow(search, ", ".join(f"{c} bigint" for c in FOUND))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.limit(0).select(*[F.col("vec_id").alias(c) for c in FOUND])
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    first = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    mine = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    passed = F.count_if(mine).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left = first.withColumn("passed", passed).where(~(mine & (F.col("passed") == 1)))
    rank = F.col("place") - F.least(F.col("passed"), F.lit(1)).cast("int")
    answers = left.withColumn("rank", rank).where(F.col("rank") <= k)
    return answers.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select("query_id", "rank", "vec_id", "score")


def _blocks(asking: DataFrame) -> Iterator[tuple[np.ndarray, list[list[int]], np.ndarray]]:
    held: list[tuple[int, list[int], int]] = []

    def block() -> tuple[np.ndarray, list[list[int]], np.ndarray]:
        ids, rows, times = zip(*held)
        return np.array(ids, np.int64), list(rows), np.array(times, np.int64)

    for r in asking.toLocalIterator():
        held.append(tuple(r))
        if len(held) == QUERIES:
            yield block()
            held.clear()
    if held:
        yield block()
