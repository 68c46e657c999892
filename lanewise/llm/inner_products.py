"""Exact search for the largest inner products by buckets of like length.

1. Vectors become integers, and rows are sorted by length over all partitions (ties by a digest of the vector, then by id, so a vector that fills a
   third of the table lies in many partitions). Runs of like length are buckets: a bucket is one row with ids, lengths and integers, longest first.
2. A query gets a floor, its k-th best product with the longest bucket: no bucket whose greatest length times the query's is below it matters. The scan
   skips those, by a pushed filter for a whole group of queries, and by a comparison for each query.
3. In a bucket the floor over both lengths is a local threshold for the cosine. High thresholds prune by coordinates: the query's largest coordinates each
   allow an interval, the shortest list of a sorted coordinate gives candidates, and what the focus coordinates leave bounds the rest. Low thresholds,
   and intervals that hold too much, prune by length: the products with the bucket's front rows that are long enough.
4. Products are verified in exact arithmetic: 32-bit floats while no partial sum can reach 2^24, 64-bit ones to 2^53, integers beyond.

Queries form groups of GROUP_BYTES, which are sent to tasks once each; a pass over the buckets serves a group, and a task keeps k rows a query whatever number of
buckets it scans, so floors rise as it goes. What is shuffled afterwards is k rows a query and task, less what is under the floor.
Of equal vectors in a bucket no more than 2 k rows, with at most k of an id, can be among a query's best, so the others are left out: they lose every tie.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; zero vectors do, with products of 0.
An integer component beyond 2^62 counts as that, a product beyond 64 bits as the largest there is. Vectors of another dimension than the query's are no candidates of it.
Rows that share an id are candidates each and ask together: all pairs of rows with different ids are ranked, ties go to the smaller id.
With fewer than k candidates all are returned; an empty table gives an empty result; other columns don't matter, whatever their names.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import dropped, finite, integer_rows, small_batches, written

K = 5
#: Rows of a bucket; and its least rows before a fall of length ends it.
ROWS, FEW = 2048, 256
#: The shortest vector of a full bucket has so much of the longest one's length.
LIKE = 0.9
#: All vectors of a group of queries take no more bytes than about this.
GROUP_BYTES = 32_000_000
#: Queries that meet a bucket at a time.
CHUNK = 256
#: Local cosine thresholds from which coordinates prune; how many coordinates of the query.
COORDINATES_FROM, FOCUS = 0.8, 4
#: Dimensions for which the longest bucket is sent to give floors; vectors of others start without.
SEEDS = 32
NONE = -(2**63) + 1
#: What rounding of lengths may hide.
SLACK = 1e-9

Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


class Bucket:
    """Rows of like length, longest first."""

    def __init__(self, dim: int, ids: bytes, lengths: bytes, values: bytes) -> None:
        self.ids, self.lengths = np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<f8")
        self.values = np.frombuffer(values, f"<i{len(values) // max(1, dim * len(self.ids))}").reshape(len(self.ids), dim) if dim else np.zeros((len(self.ids), 0), "<i2")
        self.most, self._unit, self._sorted, self._as = self.lengths[0], None, {}, {}

    def unit(self) -> np.ndarray:
        if self._unit is None:
            self._unit = self.values / np.where(self.lengths > 0, self.lengths, 1)[:, None]
        return self._unit

    def sorted(self, column: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows in the order of a coordinate, and its values."""
        if column not in self._sorted:
            order = np.argsort(self.unit()[:, column], kind="stable")
            self._sorted[column] = order, self.unit()[order, column]
        return self._sorted[column]

    def cast(self, kind: type) -> np.ndarray:
        if kind not in self._as:
            self._as[kind] = self.values.astype(kind)
        return self._as[kind]


class Best:
    """The k best of each query so far, best first, and the floor under which nothing counts."""

    def __init__(self, floors: np.ndarray, k: int) -> None:
        self.k, self.floors = k, floors.copy()
        self.scores, self.ids = np.full((len(floors), k), NONE, "<i8"), np.full((len(floors), k), 2**63 - 1, "<i8")

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(query):
            return
        asked = np.unique(query)
        query = np.concatenate([query, np.repeat(asked, self.k)])
        ids, scores = np.concatenate([ids, self.ids[asked].ravel()]), np.concatenate([scores, self.scores[asked].ravel()])
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.ids[query[kept], place[kept]], self.scores[query[kept], place[kept]] = ids[kept], scores[kept]
        self.floors[asked] = np.maximum(self.floors[asked], self.scores[asked, -1])

    def found(self) -> Pairs:
        query, place = np.nonzero((self.scores > NONE) & (self.scores >= self.floors[:, None]))
        return query, self.ids[query, place], self.scores[query, place]


def kind_for(bound: float) -> type:
    """A type in which sums of products whose absolute values add up to no more than bound are exact."""
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object


def whole(products: np.ndarray) -> np.ndarray:
    if products.dtype == object:
        products = np.array([max(NONE + 1, min(2**63 - 1, v)) for v in products.ravel()], dtype="<i8").reshape(products.shape)
    return products.astype("<i8")


def front_pairs(bucket: Bucket, values: np.ndarray, own: np.ndarray, lengths: np.ndarray, floors: np.ndarray, k: int) -> Pairs:
    """Products with the rows that are long enough for any of the queries."""
    reach = (lengths.max() if len(lengths) else 0) * bucket.most * (1 + SLACK)
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where((floors > 0) & (lengths > 0), floors / lengths, 0).min()
    rows = int(np.searchsorted(-bucket.lengths, -need * (1 - SLACK), side="right"))
    kind = kind_for(reach)
    products = values.astype(kind) @ bucket.cast(kind)[:rows].T
    if kind is object:
        products = whole(products)
    fits = (products >= floors.astype(products.dtype)[:, None]) & (bucket.ids[None, :rows] != own[:, None])
    if rows > 4 * k and fits.sum() > 8 * k * len(values):
        lowest = NONE if products.dtype.kind == "i" else -np.inf
        kth = np.partition(np.where(fits, products, lowest), rows - k, axis=1)[:, rows - k]
        fits &= products >= kth[:, None]
    query, row = np.nonzero(fits)
    return query, row, whole(products[query, row])


def coordinate_pairs(bucket: Bucket, values: np.ndarray, lengths: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which queries coordinates serve, and the (query, row) that their intervals and the bound on the rest leave."""
    unit, rows, n = values / lengths[:, None], len(bucket.ids), len(values)
    focus = np.argpartition(-np.abs(unit), min(FOCUS, unit.shape[1]) - 1, axis=1)[:, :FOCUS]
    at = np.take_along_axis(unit, focus, 1)
    t = np.minimum(1, local)[:, None] * (1 - SLACK)
    half = np.sqrt(np.maximum(0, (1 - t * t) * (1 - at * at)))
    low = np.where(at <= -t, -1.0, at * t - half) - SLACK
    high = np.where(at >= t, 1.0, at * t + half) + SLACK
    start, end = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
    for column in np.unique(focus):
        here = focus == column
        ordered = bucket.sorted(int(column))[1]
        start[here], end[here] = np.searchsorted(ordered, low[here]), np.searchsorted(ordered, high[here], side="right")
    best = (end - start).argmin(1)
    each = np.arange(n)
    size = (end - start)[each, best]
    served = size <= rows // 8
    asks = each[served]
    size, start, column = size[served], start[served, best[served]], focus[served, best[served]]
    query = np.repeat(asks, size)
    place = np.arange(len(query)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    of = np.repeat(column, size)
    row = np.zeros(len(query), np.int64)
    for c in np.unique(column):
        here = of == c
        row[here] = bucket.sorted(int(c))[0][place[here]]
    p = bucket.unit()[row[:, None], focus[query]]
    q = at[query]
    rest = np.sqrt(np.maximum(0, 1 - (p * p).sum(1)) * np.maximum(0, 1 - (q * q).sum(1)))
    left = (p * q).sum(1) + rest >= local[query] * (1 - SLACK) - SLACK
    return served, query[left], row[left]


def scan(bucket: Bucket, group: dict[str, np.ndarray], best: Best, only: Callable[[str], None] | None = None) -> None:
    """The bucket's part in the k best of a group's queries, which come by falling reach. only: hears which way prunes, for tests."""
    for lo in range(0, len(group["ids"]), CHUNK):
        part = np.arange(lo, min(lo + CHUNK, len(group["ids"])))
        reach = group["lengths"][part] * bucket.most
        part = part[reach + np.abs(reach) * SLACK >= best.floors[part]]
        if not len(part):
            continue
        lengths, floors = group["lengths"][part], best.floors[part].astype(float)
        local = np.divide(floors, lengths * bucket.most, out=np.zeros(len(part)), where=(lengths * bucket.most > 0) & (floors > 0))
        high = local >= COORDINATES_FROM
        if high.any():
            asks = part[high]
            served, query, row = coordinate_pairs(bucket, group["values"][asks], lengths[high], local[high])
            query = asks[query]
            other = bucket.ids[row] != group["ids"][query]
            query, row = query[other], row[other]
            kind = kind_for(lengths.max() * bucket.most * (1 + SLACK))
            kind = np.int64 if kind is not object else object
            products = whole((group["values"][query].astype(kind) * bucket.values[row].astype(kind)).sum(1)) if len(query) else np.zeros(0, "<i8")
            fits = products >= best.floors[query]
            best.add(query[fits], bucket.ids[row[fits]], products[fits])
            if only and served.any():
                only("coordinates")
            high[np.flatnonzero(high)[~served]] = False
        part = part[~high]
        if len(part):
            query, row, products = front_pairs(bucket, group["values"][part], group["ids"][part], group["lengths"][part], best.floors[part], best.k)
            best.add(part[query], bucket.ids[row], products)
            if only:
                only("length")


def without_copies(ids: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Which rows of equal vectors count: with the least ids, k rows an id at most, and 2 k in all."""
    order = np.lexsort((ids, *values.T[::-1]))
    v, i, at = values[order], ids[order], np.arange(len(ids))
    new = np.concatenate([[True], (v[1:] != v[:-1]).any(1)])
    new_id = new | np.concatenate([[True], i[1:] != i[:-1]])
    of_id = at - np.maximum.accumulate(np.where(new_id, at, 0)) < k
    before = np.cumsum(of_id) - of_id
    kept = of_id & (before - np.maximum.accumulate(np.where(new, before, 0)) < 2 * k)
    return np.sort(order[kept])


def bucketed(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (id, dim, length, values) as buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count, dim, most = 0, -1, 0.0

        def emit() -> pa.RecordBatch:
            ids, lengths = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            values = np.concatenate([h[2] for h in held])
            kept = without_copies(ids, values, k)
            fields = [pa.array([x.tobytes()], pa.binary()) for x in (ids[kept], lengths[kept], values[kept])]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([most], pa.float64()), *fields], ["dim", "most", "ids", "lengths", "values"])

        for batch in batches:
            ids, dims, lengths = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            for d in sorted(set(dims.tolist())):
                rows = np.flatnonzero(dims == d)
                values = integer_rows(batch.column(3).take(pa.array(rows)), d)
                at = 0
                while at < len(rows):
                    if count and (d != dim or count >= ROWS or count >= FEW and lengths[rows[at]] < LIKE * most):
                        yield emit()
                        held, count = [], 0
                    if not count:
                        dim, most = d, float(lengths[rows[at]])
                    like = int(np.searchsorted(-lengths[rows], -LIKE * most, side="right"))
                    stop = min(len(rows), at + ROWS - count, max(like, at + FEW - count, at + 1))
                    held.append((ids[rows[at:stop]], lengths[rows[at:stop]], values[at:stop]))
                    count, at = count + stop - at, stop
        if count:
            yield emit()

    return run


def coded(scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, asks, vector) as id, asks, dim, length, mark and the integers floor(scale * component) in two or eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                vectors = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), dim)
                with np.errstate(over="ignore"):
                    values = np.clip(np.floor(scale * vectors), -(2.0**62), 2.0**62).astype("<i8")
                lengths = np.sqrt((values.astype(float) ** 2).sum(1))
                marks = (values * np.random.default_rng(11).integers(-(2**62), 2**62, dim)).sum(1, dtype="<i8") if dim else np.zeros(len(rows), "<i8")
                width = 2 if not values.size or np.abs(values).max() < 2**15 else 8
                offsets = np.arange(len(rows) + 1, dtype="<i4") * (width * dim)
                data = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.astype(f"<i{width}").tobytes())])
                index = pa.array(rows)
                columns = [batch.column(0).take(index), batch.column(1).take(index), pa.array(np.full(len(rows), dim, "<i4")), pa.array(lengths), pa.array(marks), data]
                yield pa.RecordBatch.from_arrays(columns, ["id", "asks", "dim", "length", "mark", "values"])

    return run


def floored(seeds: dict[int, Bucket], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Queries (id, dim, length, values) with the k-th best product of their dimension's longest bucket, and the length that candidates need for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, lengths = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            floors = np.full(len(ids), NONE, "<i8")
            for dim in set(dims.tolist()) & set(seeds):
                rows = np.flatnonzero(dims == dim)
                best = Best(floors[rows], k)
                scan(seeds[dim], {"ids": ids[rows], "lengths": lengths[rows], "values": integer_rows(batch.column(3).take(pa.array(rows)), dim)}, best)
                floors[rows] = best.floors
            need = np.divide(floors, lengths, out=np.zeros(len(ids)), where=(lengths > 0) & (floors > 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors), pa.array(need)], ["id", "dim", "length", "values", "floor", "need"])

    return run


def top_products(vectors: DataFrame, queries: Column, k: int = K, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row for which queries holds, over floor(scale * component), with all other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.col(vector).alias("v"))
    rows = rows.filter(finite(F.col("v")) & F.col("id").isNotNull())
    with small_batches(spark):
        rows = rows.mapInArrow(coded(scale), "id long, asks boolean, dim int, length double, mark long, values binary")
        order = ("dim", F.desc("length"), "mark", "id")
        ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
        buckets = written(ordered.select("id", "dim", "length", "values").mapInArrow(bucketed(k), "dim int, most double, ids binary, lengths binary, values binary"), "buckets")
        longest = buckets.groupBy("dim").agg(F.max_by(F.struct("ids", "lengths", "values"), "most").alias("b")).orderBy("dim").limit(SEEDS)
        seeds = {r.dim: Bucket(r.dim, bytes(r.b.ids), bytes(r.b.lengths), bytes(r.b["values"])) for r in longest.collect()}
        asked = rows.filter("asks").select("id", "dim", "length", "values").mapInArrow(floored(seeds, k), "id long, dim int, length double, values binary, floor long, need double")
        asked = written(asked, "asked")
        size = asked.agg(F.sum(F.octet_length("values") + 40)).first()[0] or 0
        count = max(1, -(-size // GROUP_BYTES))
        if count > 1:
            grouped = written(asked.repartitionByRange(count, "need", "id").withColumn("part", F.spark_partition_id()), "asked")
            dropped(asked)
        else:
            grouped = asked.withColumn("part", F.lit(0))
        passes = [_pass(buckets, grouped.filter(F.col("part") == g).drop("part"), k) for g in range(count)]
        dropped(buckets, grouped if count > 1 else asked)
    found = reduce(DataFrame.unionByName, passes)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(buckets: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of a group of queries, of bounded size, whose vectors every task gets once."""
    rows = asked.toArrow()
    dims, need = rows["dim"].to_numpy(), rows["need"].to_numpy()
    groups: dict[int, dict[str, np.ndarray]] = {}
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        at = at[np.argsort(need[at], kind="stable")]
        part = rows.take(pa.array(at)).combine_chunks()
        values = integer_rows(part["values"].combine_chunks() if isinstance(part["values"], pa.ChunkedArray) else part["values"], dim)
        groups[dim] = {"ids": part["id"].to_numpy(), "lengths": part["length"].to_numpy(), "floors": part["floor"].to_numpy(), "values": values}
    sent = asked.sparkSession.sparkContext.broadcast(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, best = sent.value, {}
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                if dim in groups:
                    bucket = Bucket(dim, *[batch.column(c)[i].as_py() for c in (1, 2, 3)])
                    best.setdefault(dim, Best(groups[dim]["floors"], k))
                    scan(bucket, groups[dim], best[dim])
        for dim, b in best.items():
            query, ids, scores = b.found()
            for lo in range(0, len(query), 65_536):
                part = slice(lo, lo + 65_536)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (groups[dim]["ids"][query[part]], ids[part], scores[part])], ["query_id", "vec_id", "score"])

    needed = buckets.filter(F.col("most") >= float(need.min() if len(need) else np.inf) * (1 - SLACK)).select("dim", "ids", "lengths", "values")
    out = written(needed.mapInArrow(run, "query_id long, vec_id long, score long"), "products")
    sent.unpersist()
    return out
