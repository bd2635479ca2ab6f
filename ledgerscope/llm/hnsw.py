"""Nearest neighbours by inner product with a small-world graph per shard.

Vectors are dealt into shards of about ``SHARD`` by a hash. Each shard is one task's
hierarchical navigable small-world graph: vectors get levels at random (a hash of their id), each level keeps
flat arrays of neighbours, and a search goes down the levels and then widens to a beam on the lowest one. Points are
inserted in batches that find their neighbours in the graph so far and among themselves; searches of a batch
walk side by side in array operations. The inner product is turned into a distance by one
more coordinate that brings all vectors to the longest one's length. Every query is asked of every
shard, and the shards' results are merged with exact scores.

Vectors that are null, zero, of another length than most, or hold null or not finite
components take no part. Graphs hold distinct vectors; each stands for its rows, of which the ``count`` smallest ids other than the
query's are given. Repeated rows are rows of their own; a query never finds its own row's id. Ties go to the smaller id. Fewer candidates than asked for give all of them. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import mapped

SHARD = 8192
LINKS = 16  # neighbours on the upper levels; twice as many on the lowest
BUILD_BEAM = 64
MATES = 32  # points of the same batch that one looks at when it is inserted
BEAM = 160
BATCH = 512


def _apart(points: np.ndarray, at: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own row of points; infinite for place -1."""
    gap = points[np.maximum(at, 0)] - queries[:, None, :]
    return np.where(at < 0, np.inf, np.einsum("qkd,qkd->qk", gap, gap))


class Graph:
    def __init__(self, points: np.ndarray, levels: np.ndarray):
        self.points, self.levels = points, levels
        self.tables = [np.full((len(points), 2 * LINKS if level == 0 else LINKS), -1, np.int32) for level in range(int(levels.max()) + 1)]
        order = np.argsort(-levels, kind="stable")  # from the highest level down, so the first is a lasting entry
        self.entry = int(order[0])
        top = int(levels[self.entry])
        start, size = 1, 1
        while start < len(order):
            batch = order[start : start + size]
            self._insert(batch, top)
            start += len(batch)
            size = min(BATCH, start)
        del self.levels

    def _search(self, queries: np.ndarray, at: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest points found from the places ``at`` (a row for each query), nearest first, and their distances."""
        table = self.tables[level]
        n = len(queries)
        found = np.full((n, beam), -1, np.int64)
        apart = np.full((n, beam), np.inf)
        open_ = np.zeros((n, beam), bool)
        near = _apart(self.points, at, queries)
        order = np.argsort(near, axis=1, kind="stable")[:, :beam]
        width = order.shape[1]
        found[:, :width], apart[:, :width] = np.take_along_axis(at, order, 1), np.take_along_axis(near, order, 1)
        open_[:, :width] = found[:, :width] >= 0
        seen = np.zeros((n, len(self.points)), bool)
        rows, columns = np.nonzero(at >= 0)
        seen[rows, at[rows, columns]] = True
        active = np.arange(n)
        while len(active):
            best = np.argmax(open_[active], axis=1)  # nearest first, so the first open one is the nearest
            has = open_[active, best]
            active, best = active[has], best[has]
            if not len(active):
                break
            open_[active, best] = False
            new = table[found[active, best]].astype(np.int64)
            fresh = (new >= 0) & ~seen[active[:, None], np.maximum(new, 0)]
            new = np.where(fresh, new, -1)
            rows, columns = np.nonzero(fresh)
            seen[active[rows], new[rows, columns]] = True
            distance = _apart(self.points, new, queries[active])
            distance[distance >= apart[active, -1:]] = np.inf
            some = np.isfinite(distance).any(axis=1)
            grow = active[some]
            both = np.concatenate([apart[grow], distance[some]], axis=1)
            order = np.argsort(both, axis=1, kind="stable")[:, :beam]
            apart[grow] = np.take_along_axis(both, order, 1)
            found[grow] = np.take_along_axis(np.concatenate([found[grow], new[some]], axis=1), order, 1)
            open_[grow] = np.take_along_axis(np.concatenate([open_[grow], np.isfinite(distance[some])], axis=1), order, 1)
        return found, apart

    def _chosen(self, at: np.ndarray, candidates: np.ndarray, apart: np.ndarray, count: int) -> np.ndarray:
        """Up to ``count`` candidates for each point, nearest first, without those that lie nearer to a chosen one than to the point."""
        order = np.argsort(apart, axis=1, kind="stable")
        candidates, apart = np.take_along_axis(candidates, order, 1), np.take_along_axis(apart, order, 1)
        place = self.points[np.maximum(candidates, 0)]
        square = np.einsum("bkd,bkd->bk", place, place)
        between = square[:, :, None] + square[:, None, :] - 2 * place @ place.transpose(0, 2, 1)
        nearest = np.full(apart.shape, np.inf)
        taken = np.zeros(apart.shape, bool)
        left = np.full(len(at), count)
        for k in range(apart.shape[1]):
            take = np.isfinite(apart[:, k]) & (nearest[:, k] > apart[:, k]) & (left > 0)
            taken[:, k] = take
            left[take] -= 1
            nearest[take] = np.minimum(nearest[take], between[take, k])
        # Places left over go to the nearest of the others.
        rest = np.isfinite(apart) & ~taken
        taken |= rest & (np.cumsum(rest, axis=1) <= left[:, None])
        order = np.argsort(~taken, axis=1, kind="stable")[:, :count]
        result = np.where(np.take_along_axis(taken, order, 1), np.take_along_axis(candidates, order, 1), -1)
        return np.pad(result, ((0, 0), (0, count - result.shape[1])), constant_values=-1)

    def _insert(self, batch: np.ndarray, top: int) -> None:
        queries = self.points[batch]
        at = np.full((len(batch), 1), self.entry, np.int64)
        among = ((queries[:, None, :] - queries[None, :, :]) ** 2).sum(axis=2) if len(batch) > 1 else np.full((1, 1), np.inf)
        np.fill_diagonal(among, np.inf)
        for level in range(top, -1, -1):
            own = np.flatnonzero(self.levels[batch] >= level)
            lower = np.flatnonzero(self.levels[batch] < level)
            next_at = np.full((len(batch), BUILD_BEAM), -1, np.int64)
            if len(lower):
                next_at[lower, :1] = self._search(queries[lower], at[lower], level, 1)[0]
            if len(own):
                found, apart = self._search(queries[own], at[own], level, BUILD_BEAM)
                next_at[own] = found
                inside = among[np.ix_(own, own)]
                mates = np.broadcast_to(batch[own], inside.shape)
                close = np.argsort(inside, axis=1, kind="stable")[:, :MATES]
                candidates = np.concatenate([found, np.take_along_axis(mates, close, 1)], axis=1)
                apart = np.concatenate([apart, np.take_along_axis(inside, close, 1)], axis=1)
                chosen = self._chosen(batch[own], candidates, apart, LINKS)
                self.tables[level][batch[own], :LINKS] = chosen
                self._link_back(level, batch[own], chosen)
            at = next_at

    def _link_back(self, level: int, points: np.ndarray, chosen: np.ndarray) -> None:
        """Adds the opposite links; a point with too many keeps a chosen set."""
        table = self.tables[level]
        width = table.shape[1]
        rows, columns = np.nonzero(chosen >= 0)
        target, source = chosen[rows, columns], points[rows]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        extra = np.full((len(nodes), int(counts.max(initial=0))), -1, np.int64)
        step = np.arange(len(target)) - np.repeat(first, counts)
        extra[np.repeat(np.arange(len(nodes)), counts), step] = source
        twice = (extra[:, :, None] == table[nodes][:, None, :]).any(axis=2)
        extra[twice] = -1
        both = np.concatenate([table[nodes].astype(np.int64), extra], axis=1)
        for at in range(0, len(nodes), 256):
            part, own = both[at : at + 256], nodes[at : at + 256]
            many = (part >= 0).sum(axis=1) > width
            few = part[~many]
            table[own[~many]] = np.take_along_axis(few, np.argsort(few < 0, axis=1, kind="stable")[:, :width], 1)
            if many.any():
                apart = _apart(self.points, part[many], self.points[own[many]])
                nearest = np.argsort(apart, axis=1, kind="stable")[:, : 4 * width]
                table[own[many]] = self._chosen(own[many], np.take_along_axis(part[many], nearest, 1), np.take_along_axis(apart, nearest, 1), width)

    def nearest(self, queries: np.ndarray, count: int, beam: int) -> np.ndarray:
        """Places of the nearest points found, nearest first, -1 where there are no more."""
        at = np.full((len(queries), 1), self.entry, np.int64)
        for level in range(len(self.tables) - 1, 0, -1):
            at = self._search(queries, at, level, 1)[0]
        return self._search(queries, at, 0, max(beam, count))[0][:, :count]


class Shard:
    """The graph of one shard's distinct vectors, and exact scores of what it finds. Each vector stands for all rows that have it."""

    def __init__(self, names: np.ndarray, points: np.ndarray, most: float):
        order = np.argsort(names, kind="stable")
        names, points = names[order], points[order] + 0.0  # -0.0 becomes 0.0
        _, first, group = np.unique(points.view(f"V{points.itemsize * points.shape[1]}").ravel(), return_index=True, return_inverse=True)
        turn = np.argsort(first)  # by the least id of each
        rank = np.empty(len(turn), np.int64)
        rank[turn] = np.arange(len(turn))
        group = rank[group]
        self.points, self.most = points[first[turn]], most
        rows = np.argsort(group, kind="stable")  # ids ascend within a group
        self.names, group = names[rows], group[rows]
        self.ends = np.searchsorted(group, np.arange(len(turn) + 1))
        self.known, code = np.unique(self.names, return_inverse=True)
        self.keys = group * (len(self.known) + 1) + code
        # Vectors that only rows of one id have: these give nothing to a query of that id.
        alone = code[self.ends[:-1]] == code[self.ends[1:] - 1]
        self.alone = np.bincount(code[self.ends[:-1]][alone], minlength=len(self.known) + 1)
        rest = np.sqrt(np.maximum(most - (self.points**2).sum(axis=1), 0))
        mixed = (np.arange(len(turn), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        uniform = ((mixed >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
        self.graph = Graph(np.c_[self.points, rest].astype(np.float32), (-np.log(uniform) / np.log(LINKS)).astype(np.int64))

    def answer(self, ids: np.ndarray, queries: np.ndarray, count: int, beam: int) -> Iterator[pa.RecordBatch]:
        """The best ``count`` rows found for each query; more vectors are looked for where the query's own id has many."""
        code = np.searchsorted(self.known, ids)
        code[self.known[np.minimum(code, len(self.known) - 1)] != ids] = len(self.known)
        spare = np.maximum(self.alone[code], 1)
        for more in np.unique(spare).tolist():
            own = spare == more
            yield self._answer(ids[own], code[own], queries[own], count, min(count + more, len(self.points)), beam)

    def _answer(self, ids: np.ndarray, code: np.ndarray, queries: np.ndarray, count: int, vectors: int, beam: int) -> pa.RecordBatch:
        length = np.sqrt(self.most / (queries**2).sum(axis=1, keepdims=True))  # the scale of a query does not change its order
        found = self.graph.nearest(np.c_[queries * length, np.zeros(len(queries))].astype(np.float32), vectors, beam)
        rows, columns = np.nonzero(found >= 0)
        place = found[rows, columns]
        score = (queries[rows] * self.points[place]).sum(axis=1)
        # Each vector's least ids; those of the query's own id, which lie side by side, are stepped over.
        key = place * (len(self.known) + 1) + code[rows]
        left, right = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        at = self.ends[place][:, None] + np.arange(count)
        at += np.where(at >= left[:, None], (right - left)[:, None], 0)
        pair, column = np.nonzero(at < self.ends[place + 1][:, None])
        rows, score, names = rows[pair], score[pair], self.names[at[pair, column]]
        order = np.lexsort((names, -score, rows))
        rows, score, names = rows[order], score[order], names[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < count
        return pa.RecordBatch.from_pydict({"query_id": ids[rows[best]], "vec_id": names[best], "score": score[best]})


def usable(vector: Column) -> Column:
    """Whether a vector can take part: not null or zero, all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbours(vectors: DataFrame, is_query: Column, count: int, id_column: str = "vec_id", column: str = "embedding", beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the ``count`` nearest other vectors found, by inner product."""
    chosen = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"), is_query.alias("asks"))
    chosen = chosen.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    sizes = chosen.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("rows"), F.max(square).alias("most"))
    shape = sizes.orderBy(F.desc("rows"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return vectors.sparkSession.createDataFrame([], schema)
    size, most = shape["size"], shape["most"]
    shards = -(-shape["rows"] // shard)
    # Repeated ids are spread by the hash of the whole row, equal rows by a random number: any dealing is right.
    points = chosen.where(F.size("vector") == size).withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector", F.floor(F.rand(7) * 1024)), F.lit(shards)).cast("int"))
    queries = chosen.where((F.size("vector") == size) & F.col("asks"))
    each = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asks", F.lit(True))
    both = points.withColumn("asks", F.lit(False)).unionByName(each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, points before queries: points are gathered, the graph is built, queries are answered batch by batch."""
        current, parts, graph = None, [], None
        for batch in batches:
            numbers, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)]):
                if start == stop:
                    continue
                if numbers[start] != current:
                    current, parts, graph = numbers[start], [], None
                ids = batch.column(2).to_numpy()[start:stop]
                own = batch.column(3).slice(start, stop - start).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                if not asks[start]:
                    parts.append((ids, own))
                elif parts:
                    graph = graph or Shard(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), most)
                    for at in range(0, len(ids), BATCH):
                        yield from graph.answer(ids[at : at + BATCH], own[at : at + BATCH], count, beam)

    dealt = both.select("shard", "asks", "vec_id", "vector").repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    found = mapped(dealt, run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count)
    return ranked.select("query_id", "rank", "vec_id", "score")
