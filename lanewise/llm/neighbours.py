"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds.

A unit vector is rotated and keeps one bit for each dimension, packed into words, with one correction scalar: its inner
product with its own code. A query's inner product with a code, divided by the scalar, estimates the cosine, within a bound
that follows from the scalar and the dimension. The nearest by estimate are reranked by their exact cosine, in double precision; then all whose
upper bound reaches the k-th best so found.

Vectors are packed into blocks of rows inside their partitions and encoded there, once. A block's codes are scanned for all queries, and only vectors that
are to be reranked are looked at again. All queries are one broadcast row while their bytes, counted beforehand, are within a bound; beyond it they form
groups of that size, and blocks are dealt to the groups with their codes. A block gives k rows a query, so what is merged stays small.

Of equal vectors in a block only the k + 1 with the least ids can be among the k nearest of a query, so the others are left out:
a vector that fills a third of the table costs as much as any.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor as queries, nor do rows with a null id; vectors of
another length than the query's are no candidates of it; rows that share an id are one candidate and one query, with the best score of any of their
vectors; ties go to the smaller id; with fewer than k candidates all are returned; an empty table gives an empty result; other columns don't matter,
whatever their names. Vectors are scaled by a power of two first, so very long and very short ones lose nothing.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import kept_by_worker

K = 5
ROWS = 16_384
#: Pairs whose vectors are gathered at a time.
PIECE = 32_768
#: All components of one group of queries take no more bytes than this.
GROUP_BYTES = 64_000_000
#: Standard deviations of the estimate's error that a bound allows for.
DEVIATIONS = 2.5
SEED = 77


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dim: int) -> np.ndarray:
    def make() -> np.ndarray:
        q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
        return q * np.sign(np.diag(r))

    return kept_by_worker("rotation", dim, make)


def one_bit(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs [n, words] and the inner product of each rotated vector with its code."""
    turned = unit @ turn
    bits = turned > 0
    pad = np.zeros((len(unit), -unit.shape[1] % 64), bool)
    codes = np.packbits(np.concatenate([bits, pad], 1), axis=1, bitorder="little").view("<u8")
    return codes, np.abs(turned).sum(1) / np.sqrt(unit.shape[1])


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, so that its largest component is near 1."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


def nearest(block: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine) of the k best of a block for each query, after reranking."""
    ids, vectors, scalar, dim = block["ids"], block["vectors"], block["scalars"], queries.shape[1]
    k += len(ids) - len(np.unique(ids))  # ids that repeat may fill places
    signs = np.unpackbits(block["codes"].view(np.uint8), axis=1, bitorder="little")[:, :dim].astype(np.float32) * 2 - 1
    bound = (DEVIATIONS * np.sqrt(np.maximum(0, 1 - scalar**2)) / scalar / np.sqrt(max(1, dim - 1))).astype(np.float32)
    each = (1 / (scalar * np.sqrt(dim))).astype(np.float32)
    queries = scaled(queries)
    # The same order of operations for every row, so equal vectors get equal scores.
    length, query_length = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (vectors, queries))
    turned = ((queries / query_length[:, None]) @ rotation(dim)).astype(np.float32)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(queries), 16):
        part = slice(lo, lo + 16)

        def exact(q: np.ndarray, r: np.ndarray, part: slice = part) -> np.ndarray:
            pieces = [np.einsum("ij,ij->i", vectors[r[at : at + PIECE]], queries[part][q[at : at + PIECE]]) for at in range(0, len(q), PIECE)]
            return np.concatenate([np.zeros(0), *pieces]) / (length[r] * query_length[part][q])

        about = (turned[part] @ signs.T) * each[None]
        about[ids[None] == query_ids[part][:, None]] = -np.inf
        n, m = about.shape
        front = min(m, 4 * k)
        first = np.argpartition(-about, front - 1, axis=1)[:, :front]
        score = exact(np.repeat(np.arange(n), front), first.ravel()).reshape(n, front)
        score[np.isneginf(np.take_along_axis(about, first, 1))] = -np.inf
        kth = np.partition(score, front - k, axis=1)[:, front - k] if front >= k else np.full(n, -np.inf)
        q, r = np.nonzero((about + bound[None] >= kth[:, None] - 1e-6) & ~np.isneginf(about))
        score = exact(q, r)
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        out.append((query_ids[part][q[best]], ids[r[best]], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def encoded(ids: np.ndarray, vectors: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """A block: of equal vectors the k + 1 with the least ids, their codes and scalars."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(1)])
    keep = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0)) <= k
    ids, vectors = ids[keep], scaled(vectors[keep])
    codes, scalars = one_bit(vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None], rotation(vectors.shape[1]))
    return {"ids": ids, "vectors": vectors, "codes": codes, "scalars": scalars}


def packed(rows: DataFrame, size: int, make: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], name: str, fields: tuple[str, ...]) -> DataFrame:
    """rows (id, vector) as blocks: dim and fields as bytes, as make(ids, vectors) gives them. No shuffle: blocks form inside partitions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def emit(dim: int) -> pa.RecordBatch:
            block = make(*(np.concatenate(x) for x in zip(*held.pop(dim), strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([block[f].tobytes()]) for f in fields]], ["dim", *[f"{name}_{f}" for f in fields]])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                vectors = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dim)
                for lo in range(0, len(at), size):
                    held.setdefault(int(dim), []).append((ids[at[lo : lo + size]].astype("<i8"), vectors[lo : lo + size]))
                    if sum(len(x[0]) for x in held[int(dim)]) >= size:
                        yield emit(int(dim))
        for dim in list(held):
            yield emit(dim)

    schema = T._parse_datatype_string(", ".join(["dim int", *[f"{name}_{f} binary" for f in fields]]))
    return rows.mapInArrow(pack, schema)


def search(vectors: DataFrame, queries: Column, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which queries holds, among all other rows."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.filter(usable(F.col("v")) & F.col("id").isNotNull())
    asked, fields = rows.filter("asks").select("id", "v"), ("ids", "vectors", "codes", "scalars")
    count, components = asked.agg(F.count("*"), F.sum(F.size("v"))).first()
    groups = max(1, -(-8 * (components or 0) // GROUP_BYTES))
    # One row a group and dimension; without a key, so rows are dealt evenly.
    asked = packed(asked.repartition(groups), count + 1, lambda ids, v: {"ids": ids, "vectors": v}, "q", ("ids", "vectors")).withColumn("part", F.spark_partition_id())
    held = packed(rows.select("id", "v"), ROWS, lambda ids, v: encoded(ids, v, k), "r", fields)
    if groups == 1:
        both = held.join(F.broadcast(asked), "dim")
    else:
        both = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(asked, ["dim", "part"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch.column(i)[row].as_py() for i, name in enumerate(columns)}
                rest = {"ids": "<i8", "vectors": "<f8", "codes": "<u8", "scalars": "<f8"}
                block = {f: np.frombuffer(at[f"r_{f}"], t) for f, t in rest.items()}
                block |= {f: block[f].reshape(len(block["ids"]), -1) for f in ("vectors", "codes")}
                query_values = np.frombuffer(at["q_vectors"], "<f8").reshape(-1, at["dim"])
                found = nearest(block, np.frombuffer(at["q_ids"], "<i8"), query_values, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    columns = ("dim", *[f"r_{f}" for f in fields], "q_ids", "q_vectors")
    found = both.select(*columns).mapInArrow(rank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
