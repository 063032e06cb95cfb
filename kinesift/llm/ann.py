"""Nearest neighbours by inner product: multiprobe hashing with p-stable (Gaussian) projections.

Vectors are dealt into bands by norm, a factor of 2 each, so long ones don't squeeze the rest into a few buckets. A band has a
scale and tables of its own, and a query visits all bands. Vectors are scaled by the band's largest norm and get one more coordinate that makes all norms 1; queries are scaled to
norm 1 and get a zero there. Then the largest inner product is the smallest Euclidean distance. Each of
``TABLES`` tables hashes a vector by ``floor((a.v + b) / WIDTH)`` over a few Gaussian directions a. A query visits
its own bucket and perturbed ones in the estimated order of success: the distances of its projections to
the cell borders, sorted, take the place of their expected values, for which the best sets of
perturbations are known beforehand. The candidates of all tables are ranked by the exact inner product. Queries
that find too few are compared with all vectors, block by block.

The number of directions follows the logarithm of the number of vectors, so buckets grow much more slowly than the
table, and the number of probes follows the directions, so the chance to visit a neighbour's bucket does not fall; both
at every size by the same formula. Buckets are dealt into parts, and a query meets each part once, with the list of the buckets it visits there.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesift.llm.text import stored

TABLES = 6
WIDTH = 1.5
#: Probes at four directions and fewer; every further direction takes SPREAD times as many.
PROBES = 36
SPREAD = 2.5
SEED = 29
#: Vectors, and queries, of a bucket that one task compares at once.
BLOCK = 8192


def directions_for(rows: int) -> int:
    return max(2, round(math.log2(max(rows, 2)) / 3))


def probes_for(m: int) -> int:
    return math.ceil(PROBES * SPREAD ** max(0, m - 4))


def probe_sets(m: int, probes: int) -> list[tuple[int, ...]]:
    """The most promising sets of perturbations, as places in the sorted list of the 2m distances to cell borders.

    Places j and 2m - 1 - j are the two sides of one direction and don't go together. Sets are made in order of the
    sum of their expected squared distances, by moving the last place on or adding the one after it.
    """
    low = [j * (j + 1) / (4.0 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    cost = low + [1 - 2 * j / (2.0 * (m + 1)) + j * (j + 1) / (4.0 * (m + 1) * (m + 2)) for j in range(m, 0, -1)]
    out: list[tuple[int, ...]] = [()]
    queue = [(cost[0], (0,))]
    while queue and len(out) < probes:
        total, places = heapq.heappop(queue)
        if all(2 * m - 1 - p not in places for p in places):
            out.append(places)
        last = places[-1]
        if last + 1 < 2 * m:
            heapq.heappush(queue, (total - cost[last] + cost[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(queue, (total + cost[last + 1], (*places, last + 1)))
    return out


class Hashes:
    """The tables' directions and offsets; the same for a seed everywhere."""

    def __init__(self, size: int, m: int, seed: int = SEED, tables: int = TABLES, probes: int | None = None):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(tables, size + 1, m))
        self.b = rng.uniform(0.0, WIDTH, (tables, m))
        self.odd = rng.integers(1, 1 << 62, m) | 1
        self.sets = probe_sets(m, probes or probes_for(m))
        self.m = m

    def cells(self, table: int, points: np.ndarray) -> np.ndarray:
        return (points @ self.a[table] + self.b[table]) / WIDTH

    def key(self, cells: np.ndarray) -> np.ndarray:
        return (cells.astype(np.int64) * self.odd).sum(-1)

    def probes(self, table: int, points: np.ndarray) -> np.ndarray:
        """(points, probes): bucket keys in the order of visiting."""
        at = self.cells(table, points)
        cell = np.floor(at)
        part = at - cell
        order = np.argsort(np.concatenate([part, 1 - part], 1), 1)
        keys = []
        for places in self.sets:
            moved = cell.copy()
            for p in places:
                side = order[:, p]
                moved[np.arange(len(moved)), side % self.m] += np.where(side < self.m, -1, 1)
            keys.append(self.key(moved))
        return np.stack(keys, 1)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part: a key, all components finite, not all zero, and the most frequent length."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    some = vectors.filter(v.isNotNull() & F.col(key).isNotNull()).filter(fine & F.exists(v, lambda x: x != 0))
    rows = some.select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (length["n"] if length else 0))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(v, ids): different vectors with the ``most`` smallest ids that hold them; more can't be among the nearest.

    Every batch keeps as many itself before rows meet, so a vector that very many rows hold gathers few ids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.ascontiguousarray(_matrix(batch.column(1)) + 0.0)
            ids = batch.column(0).to_numpy()
            _, first, group = np.unique(m.view(np.dtype((np.void, m.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
            order = np.lexsort((ids, group))
            place = np.arange(len(order)) - np.searchsorted(group[order], group[order])
            keep = order[place < most]
            sizes = np.bincount(group[keep], minlength=len(first))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids[keep]))
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(first)), lists], ["v", "ids"])

    merged = rows.select("id", "v").mapInArrow(cut, "v array<double>, ids array<long>").groupBy("v")
    return merged.agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))


def log_norm(v: Column) -> Column:
    most = F.array_max(F.transform(v, F.abs))
    return F.log2(most) + F.log2(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / most) * (x / most))) / 2


def nearest(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, probes: int | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row whose key is divisible by ``every``, the ``k`` nearest other rows found,
    or all others where there are fewer.

    Nearest first, ties to the smaller key. Rows whose vector is null, zero, of another length than most, or holds a
    null or non-finite component take no part, nor do rows without a key. Rows that repeat a key and vector count
    once; a key with several vectors is as near as the nearest of them. Fewer rows give fewer neighbours; an empty
    table gives an empty one.
    """
    rows = stored(usable(vectors, key, vector), "vectors")
    # Norms around a power of 2, such as 1, are in the middle of their band.
    norm = log_norm(F.col("v"))
    points = stored(distinct_vectors(rows, k + 1).select("v", "ids", norm.alias("norm"), F.floor(norm + 0.5).cast("int").alias("band")), "distinct-vectors")
    got = points.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"), F.max(F.size("v")).alias("d")).orderBy("band").collect()
    bands = [(g["band"], 2.0 ** min(g["top"], 1023.0), Hashes(g["d"], directions_for(g["n"]), probes=probes), math.ceil(2 * g["n"] / BLOCK)) for g in got]

    def part_of(spots: np.ndarray, parts: int) -> np.ndarray:
        return ((spots.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            band_of = whole.column(2).to_numpy()
            for place, (band, longest, hashes, parts) in enumerate(bands):
                batch = whole.filter(pa.array(band_of == band))
                if not batch.num_rows:
                    continue
                v = _matrix(batch.column(0)) / longest
                full = np.concatenate([v, np.sqrt(np.maximum(0.0, 1 - (v * v).sum(1)))[:, None]], 1)
                for t in range(len(hashes.a)):
                    spot = hashes.key(np.floor(hashes.cells(t, full)))
                    columns = [pa.array(np.full(len(v), place * TABLES + t, np.int32)), pa.array(part_of(spot, parts)), pa.array(spot), batch.column(0), batch.column(1)]
                    yield pa.RecordBatch.from_arrays(columns, ["t", "part", "bucket", "v", "ids"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                v = _matrix(part.column(1))
                v = v / np.abs(v).max(1)[:, None]
                full = np.concatenate([v / np.sqrt((v * v).sum(1))[:, None], np.zeros((len(v), 1))], 1)
                for place, t in ((place, t) for place in range(len(bands)) for t in range(TABLES)):
                    _, _, hashes, parts = bands[place]
                    spots = hashes.probes(t, full)
                    who, to = np.repeat(np.arange(len(v)), spots.shape[1]), part_of(spots.ravel(), parts)
                    order = np.lexsort((to, who))
                    who, to, flat = who[order], to[order], spots.ravel()[order]
                    first = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (to[1:] != to[:-1]))))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate((first, [len(flat)])).astype(np.int32)), pa.array(flat))
                    at_row = pa.array(who[first])
                    columns = [pa.array(np.full(len(first), place * TABLES + t, np.int32)), pa.array(to[first]), lists, part.column(0).take(at_row), part.column(1).take(at_row)]
                    yield pa.RecordBatch.from_arrays(columns, ["t", "part", "buckets", "id", "v"])

    queries = rows.filter(F.col("id") % every == 0)
    filed = points.select("v", "ids", "band").mapInArrow(index, "t int, part int, bucket long, v array<double>, ids array<long>")
    asked = queries.mapInArrow(visit, "t int, part int, buckets array<long>, id long, v array<double>")
    deal = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every_cell = lambda n: F.explode(F.array(*map(F.lit, range(n))))
    cell = ["t", "part", "x", "y"]

    def compare(data: pa.Table, visits: pa.Table) -> pa.Table:
        found: list[tuple[int, list[int], list[float]]] = []
        if data.num_rows and visits.num_rows:
            v, lists = _matrix(data["v"]), data["ids"].combine_chunks()
            ends = lists.offsets.to_numpy()
            ids = lists.values.to_numpy()
            q, names = _matrix(visits["v"]), visits["id"].to_numpy()
            spot = data["bucket"].to_numpy()
            by_bucket = np.argsort(spot, kind="stable")
            buckets, starts = np.unique(spot[by_bucket], return_index=True)
            stops = np.append(starts[1:], len(spot))
            asked = visits["buckets"].combine_chunks()
            who = np.repeat(np.arange(len(q)), np.diff(asked.offsets.to_numpy()))
            which = np.searchsorted(buckets, flat := asked.flatten().to_numpy())
            here = buckets[np.minimum(which, len(buckets) - 1)] == flat
            order = np.argsort(which[here], kind="stable")
            who, which = who[here][order], which[here][order]
            # The best so far of every query, over the buckets it visits.
            best, place = np.full((len(q), k + 1), -np.inf), np.full((len(q), k + 1), -1)
            for b in np.unique(which):
                inside = by_bucket[starts[b] : stops[b]]
                visitors = np.unique(who[np.searchsorted(which, b) : np.searchsorted(which, b, "right")])
                for at in range(0, len(visitors), 512):
                    w = visitors[at : at + 512]
                    near = np.concatenate([best[w], q[w] @ v[inside].T], 1)
                    spots = np.concatenate([place[w], np.broadcast_to(inside, (len(w), len(inside)))], 1)
                    top = np.argpartition(-near, k, axis=1)[:, : k + 1]
                    best[w], place[w] = np.take_along_axis(near, top, 1), np.take_along_axis(spots, top, 1)
            for i in np.unique(who):
                spots = place[i][place[i] >= 0]
                exact = (v[spots] * q[i]).sum(1)
                sizes = ends[spots + 1] - ends[spots]
                holders = np.concatenate([ids[ends[s] : ends[s + 1]] for s in spots])
                score = np.repeat(exact, sizes)
                order = np.lexsort((holders, -score))
                order = order[holders[order] != names[i]][:k]
                found.append((int(names[i]), holders[order], score[order]))
        return pa.table(
            [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.float64()))],
            ["query_id", "ids", "scores"],
        )

    shape = "query_id long, ids array<long>, scores array<double>"

    def met(filed: DataFrame, asked: DataFrame) -> DataFrame:
        """Parts over BLOCK vectors or visits are dealt into a grid of cells: each vector to one row of it, each visit to one column."""
        most = [stored(x.groupBy("t", "part").agg(F.count(F.lit(1)).alias("n")), "part-sizes").agg(F.max("n")).first()[0] or 1 for x in (filed, asked)]
        across, down = (math.ceil(m / BLOCK) for m in most)
        data = filed.withColumn("x", deal("v", across)).withColumn("y", every_cell(down))
        visits = asked.withColumn("y", deal("id", down)).withColumn("x", every_cell(across))
        found = data.groupBy(*cell).cogroup(visits.groupBy(*cell)).applyInArrow(compare, shape)
        return found.groupBy("query_id").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")

    def merge(lists: pa.Table) -> pa.Table:
        lists = lists.combine_chunks()
        who, score = (lists[c].combine_chunks().flatten().to_numpy() for c in ("ids", "scores"))
        order = np.lexsort((who, -score))
        _, first = np.unique(who[order], return_index=True)
        order = order[np.sort(first)[:k]]
        query = pa.array(np.full(len(order), lists["query_id"][0].as_py(), np.int64))
        return pa.table([query, pa.array(np.arange(1, len(order) + 1, dtype=np.int32)), pa.array(who[order]), pa.array(score[order])], ["query_id", "rank", "vec_id", "score"])

    near = stored(met(filed, asked), "neighbours")
    full = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    rest = stored(queries.join(full, "id", "left_anti"), "short-queries")
    if rest.isEmpty():
        return near
    one = [F.lit(0).alias("t"), F.lit(0).alias("part")]
    others = met(points.select(*one, F.lit(0).cast("long").alias("bucket"), "v", "ids"), rest.select(*one, F.array(F.lit(0).cast("long")).alias("buckets"), "id", "v"))
    return near.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(others)
