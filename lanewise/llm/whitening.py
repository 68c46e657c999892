"""Whitening of embeddings on their leading components, found by matrix-free block Lanczos.

1. Components c become integers x = floor(64 c) + 1,000,000. The fit list is each distinct x once, a table that the passes read; n rows, sums S by dimension,
   added up as integers. n x - S is a row's deviation, exact in integers, so a large common offset costs no digit.
2. A pass multiplies the covariance by a block of vectors without forming it: each task centres its rows, multiplies them by the block and back, and gives one
   partial product (dimension by block), which Spark adds up. Only the basis and such products, dimension by some dozen numbers, reach the driver.
3. Each product, orthogonalised twice against the whole basis, is the next block. Directions that vanish (an invariant subspace) are replaced by random ones, so a
   breakdown doesn't end the search while the basis doesn't span the space. Ritz pairs are taken from the basis; it ends when the residuals of all wanted ones are
   below TOLERANCE of the greatest eigenvalue, or are below ROUNDING of it and no longer fall, or the basis spans the space. A basis of BASIS blocks is cut to its best Ritz vectors, and goes on from them.
4. The trace is the sum of squared deviations over n^3, from the pass that adds them; it gives each component's explained share. A last pass measures whitened's covariance.

Every row, not only distinct ones, is then projected in its task.

Defined cases: vectors that are null or hold null or non-finite entries are dropped; so are those of another length than the most frequent one (of equally frequent ones the longer),
which no component of this space can meet. Rows that share an id are whitened each, rows without an id too. Integers beyond 2^52 count as that. A deviation beyond 64 bits is null.
Components are those with a variance above rounding: fewer than asked for where distinct vectors span less, none where all are equal; then, and for an empty table, the result is empty.
Other columns don't matter.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import dropped, finite, small_batches, written

COMPONENTS = 16
SCALE, OFFSET = 64.0, 1_000_000
#: Vectors of a block beyond those asked for; blocks of a basis before it is cut.
MORE, BASIS = 4, 12
#: Of the greatest eigenvalue: residuals of wanted pairs, and variances that are none.
TOLERANCE, ROUNDING, NOTHING = 1e-12, 1e-9, 1e-12
PASSES = 1000
SEED = 13
LIMIT = 2.0**52

Apply = Callable[[np.ndarray], np.ndarray]


def integers(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * vectors.astype(float)), -LIMIT, LIMIT).astype("<i8") + OFFSET


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, as 64-bit integers where they and their parts fit, as Python's otherwise."""
    if n * max(1, int(np.abs(x).max(initial=0))) < 2**62 and max(map(abs, sums), default=0) < 2**62:
        return n * x - np.array(sums, "<i8")
    return n * x.astype(object) - np.array(sums, object)


def squares(r: np.ndarray) -> np.ndarray:
    """The sum of squares of each row of integers, as Python's integers where 64 bits could be too few; None beyond them."""
    if len(r) and float((r.astype(float) ** 2).sum(1).max()) < 2.0**62:
        return (r.astype("<i8") ** 2).sum(1)
    exact = (r.astype(object) ** 2).sum(1)
    return np.array([int(v) if v < 2**63 else None for v in exact], object)


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """block against basis and itself; what vanishes restarts as random directions, as long as there is room for any."""
    dim, out = block.shape[0], []
    room = dim - basis.shape[1]
    for v in block.T[:room]:
        for attempt in range(20):
            size = np.linalg.norm(v)
            for _ in range(2):
                v = v - basis @ (basis.T @ v)
                for o in out:
                    v = v - o * (o @ v)
            left = np.linalg.norm(v)
            if size > 0 and left > 1e-10 * size:
                out.append(v / left)
                break
            v = rng.standard_normal(dim)
    return np.stack(out, 1) if out else np.zeros((dim, 0))


def block_lanczos(apply: Apply, dim: int, wanted: int, width: int | None = None, basis_blocks: int = BASIS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues (falling), unit eigenvectors in columns, and the number of passes, of the symmetric operator that apply multiplies blocks by."""
    rng = np.random.default_rng(SEED)
    wanted = min(wanted, dim)
    width = min(width or wanted + MORE, dim)
    basis = image = np.zeros((dim, 0))
    block = orthonormal(rng.standard_normal((dim, width)), basis, rng)
    least, since = np.inf, 0
    for passes in range(1, PASSES + 1):
        product = apply(block)
        basis, image = np.concatenate([basis, block], 1), np.concatenate([image, product], 1)
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values)
        values, turn = values[order], turn[:, order]
        vectors, images = basis @ turn, image @ turn
        residual = np.linalg.norm(images - vectors * values, axis=0)[:wanted]
        worst = residual.max() / max(abs(values[0]), np.finfo(float).tiny) if len(residual) == wanted else np.inf
        since = 0 if worst < least / 2 else since + 1
        least = min(least, worst)
        if basis.shape[1] == dim or worst <= tolerance or worst <= ROUNDING and since > basis_blocks:
            return values[:wanted], vectors[:, :wanted] / np.linalg.norm(vectors[:, :wanted], axis=0), passes
        if basis.shape[1] + width > min(dim, basis_blocks * width) and basis.shape[1] + width <= dim:
            kept = min(wanted + width, basis.shape[1])
            product = images[:, :width] - vectors[:, :width] * values[:width]
            basis, image = vectors[:, :kept], images[:, :kept]
        block = orthonormal(product, basis, rng)
    raise RuntimeError(f"no convergence in {PASSES} passes")


def vectors_of(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def partial(table: np.ndarray) -> pa.RecordBatch:
    """One task's matrix, a row each."""
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(table), dtype="<i4")), *[pa.array(c) for c in table.T]], ["i", *[f"v{j}" for j in range(table.shape[1])]])


def summed(rows: DataFrame, task: Callable[[np.ndarray], np.ndarray], dim: int, height: int, width: int) -> np.ndarray:
    """The sum over all rows (x) of task(x), a matrix of height by width: added up in each task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for batch in batches:
            total += task(vectors_of(batch.column(0), dim))
        yield partial(total)

    names = [f"v{j}" for j in range(width)]
    parts = rows.select("x").mapInArrow(run, ", ".join(["i int", *[f"{c} double" for c in names]]))
    out = np.zeros((height, width))
    for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r.i] = r[1:]
    return out


def exact_sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of rows and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            x = vectors_of(batch.column(0), dim)
            n += len(x)
            wide = len(x) * int(np.abs(x).max(initial=0)) >= 2**62
            total = total + (x.astype(object) if wide else x).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array([Decimal(int(v)) for v in [*total, n]], pa.decimal128(38, 0))], ["i", "v"])

    found = {r.i: int(r.v) for r in rows.select("x").mapInArrow(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    return found.get(dim, 0), [found.get(i, 0) for i in range(dim)]


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: each row on each of the leading components."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter(finite(F.col("v")))
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = most.d if most else 0
    if not dim:
        return spark.createDataFrame([], shape)
    rows = rows.filter(F.size("v") == dim)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(vectors_of(batch.column(0), dim))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="<i4") * dim), pa.array(x.ravel()))], ["x"])

    with small_batches(spark):
        fit = written(rows.select("v").mapInArrow(whole, "x array<bigint>").distinct(), "fit")
        n, sums = exact_sums(fit, dim)
        centred = lambda x: deviations(x, n, sums).astype(float) / n

        def apply(block: np.ndarray) -> np.ndarray:
            def task(x: np.ndarray) -> np.ndarray:
                c = centred(x)
                return c.T @ (c @ block)

            return summed(fit, task, dim, dim, block.shape[1]) / n

        trace = summed(fit, lambda x: (centred(x) ** 2).sum(0)[None], dim, 1, dim).sum() / n
        values, basis, _ = block_lanczos(apply, dim, components)
        kept = values > NOTHING * max(trace, np.finfo(float).tiny)
        values, basis = values[kept], basis[:, kept]
        m = len(values)
        if not m:
            dropped(fit)
            return spark.createDataFrame([], shape)
        whitener = basis / np.sqrt(values)

        def moments(x: np.ndarray) -> np.ndarray:
            w = centred(x) @ whitener
            return w.T @ w

        mean = summed(fit, lambda x: (centred(x) @ whitener).sum(0)[None], dim, 1, m) / n
        error = float(np.abs(summed(fit, moments, dim, m, m) / n - mean.T @ mean - np.eye(m)).max())
        dropped(fit)
        explained = values / trace

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                r = deviations(integers(vectors_of(batch.column(1), dim)), n, sums)
                size, w = squares(r), (r.astype(float) / n) @ whitener
                times = np.repeat(np.arange(len(r)), m)
                columns = [batch.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, m + 1, dtype="<i4"), len(r))), pa.array(np.full(len(times), n)), pa.array(size, pa.int64()).take(pa.array(times))]
                rest = [pa.array(w.ravel()), pa.array(np.tile(explained, len(r))), pa.array(np.full(len(times), error))]
                yield pa.RecordBatch.from_arrays([*columns, *rest], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return rows.select("vec_id", "v").mapInArrow(project, shape)
