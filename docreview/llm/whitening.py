"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Let X be the centred rows. From a unit vector v, products X v and then X' u in turn build
orthonormal bases V (short, on the driver) and U (as long as the table) with X V = U B, B upper
bidiagonal and small. B's singular values and vectors give the deviations and components. U is never
stored: its columns are X times short vectors A, so a pass over the rows makes X p, its products
with all columns of U = X A and X' X p at once. Both bases are orthogonalised in full."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreview.llm.common import free_names
from docreview.session import release, stage

#: A coordinate c becomes floor(SCALE * c) + SHIFT.
SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
LARGEST = 2.0**40
#: Residuals and singular values below this share of the largest singular value count as zero.
TOLERANCE = 1e-13
#: A vector that keeps less than this share of its square is made orthogonal a second time.
AGAIN = 0.5
#: Rows whose products are made at a time, which bounds the memory of a task.
BLOCK = 4096


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): whole coordinates of the vectors without nulls, NaNs and infinities.

    Vectors that do not have the most frequent length (of equals the longest) are left out too, and
    those with a coordinate of LARGEST or more, whose sums would not fit into 64 bits."""
    value = F.col("_v")
    valid = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    rows = df.select(F.col(key), F.col(vector).cast("array<double>").alias("_v")).where(F.coalesce(valid, F.lit(False)))
    lengths = rows.groupBy(F.size("_v").alias("d")).agg(F.count("*").alias("n"))
    dims = lengths.agg(F.max_by("d", F.struct("n", "d"))).first()[0] or 0
    return rows.where(F.size("_v") == dims).select(
        F.col(key), F.transform("_v", lambda c: (F.floor(c * SCALE) + SHIFT).cast("long")).alias("x")
    )


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def summed(rows: DataFrame, kind: str, size: int, part: Callable[[np.ndarray], np.ndarray], dims: int) -> np.ndarray:
    """The sum over blocks of rows of `part`, an array of `size` numbers. One row per partition is
    summed place by place in Spark; the driver gets `size` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            block = matrix(batch.column(0), dims)
            for at in range(0, len(block), BLOCK):
                value = part(block[at : at + BLOCK])
                total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(kinds[kind]))], ["v"])

    kinds = {"bigint": pa.int64(), "double": pa.float64()}
    parts = rows.select("x").mapInArrow(run, f"v array<{kind}>")
    places = parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(size, np.int64 if kind == "bigint" else np.float64)
    for i, v in places.collect():
        out[i] = v
    return out


def centre(block: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """Rows minus the mean: the whole part of the mean goes first, which is exact."""
    whole, rest = np.divmod(sums, n)
    return (block - whole) - rest / n


def bidiagonalise(
    product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]],
    dims: int,
    wanted: int,
    seed: int = 0,
) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (columns) of X.

    `product(p, A)` gives X'X p, (XA)'X p and the square of |X p|. Ends when the residuals of the
    first `wanted` values are zero to double precision, or with a basis of the whole space; where
    the Krylov space is used up, it goes on with a new vector orthogonal to all before."""
    random = np.random.default_rng(seed)
    v_basis, a_basis, z_basis = np.zeros((dims, 0)), np.zeros((dims, 0)), np.zeros((dims, 0))
    alphas, betas, scale = [], [], 0.0

    def fresh() -> np.ndarray:
        v = random.standard_normal(dims)
        for _ in range(2):
            v -= v_basis @ (v_basis.T @ v)
        return v / np.linalg.norm(v)

    v, beta = fresh(), 0.0
    while True:
        # u = X v - beta u', made orthogonal to all of U; where that takes much away, once more
        p = v - (beta * a_basis[:, -1] if beta else 0)
        gram, along, square = product(p, a_basis)
        if square - along @ along < AGAIN * square:
            p = p - a_basis @ along
            gram, along, square = product(p, a_basis)
        p, gram = p - a_basis @ along, gram - z_basis @ along
        alpha = np.sqrt(max(square - along @ along, 0.0))
        scale = max(scale, alpha)
        v_basis = np.column_stack([v_basis, v])
        if alpha > TOLERANCE * scale and alpha > 0:
            a, w = p / alpha, gram / alpha
        else:  # X v is in the span already: u is nothing, and a new start is needed
            alpha, a, w = 0.0, np.zeros(dims), np.zeros(dims)
        alphas.append(alpha)
        a_basis, z_basis = np.column_stack([a_basis, a]), np.column_stack([z_basis, w])
        w = w - alpha * v
        for _ in range(2):
            w -= v_basis @ (v_basis.T @ w)
        beta = float(np.linalg.norm(w))
        small = np.diag(alphas) + np.diag(betas, 1)
        left, values, right = np.linalg.svd(small)
        scale = max(scale, values[0])
        if len(alphas) == dims:
            break
        if len(alphas) >= wanted and beta > TOLERANCE * scale and max(beta * abs(left[-1, :wanted])) <= TOLERANCE * scale:
            break
        if beta > TOLERANCE * scale:
            v = w / beta
        else:
            v, beta = fresh(), 0.0
        betas.append(beta)
    return values, v_basis @ right.T


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each valid vector
    and component, numbered from 1 by falling eigenvalue of the covariance.

    Vectors that are null or hold nulls or non-finite numbers are left out, and those of another
    length than most or with a coordinate beyond LARGEST. `deviation` is exact, and null where it does not fit into 64 bits. The largest
    entry of a component is positive. There are at most `components`, and only those with a
    deviation: constant dimensions, and fewer rows than dimensions, give fewer; one row or equal
    rows give no rows, as does an empty table. Rows with a null or repeated key are rows like
    others. Other columns are not read.

    The whole coordinates are written once; every product is a pass over them, of which one row of
    numbers per partition is shuffled. The driver holds dimensions x steps numbers."""
    rows = stage(integer_vectors(df, key, vector))
    head = rows.select(F.size("x").alias("d")).limit(1).collect()
    dims = head[0].d if head else 0
    out = df.select(F.col(key)).schema.simpleString()[7:-1] + (
        ", component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    if not dims:
        return df.sparkSession.createDataFrame([], out)
    total = summed(rows, "bigint", dims + 1, lambda b: np.append(b.sum(axis=0), len(b)), dims)
    sums, n = total[:-1], int(total[-1])

    def product(p: np.ndarray, a_basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def part(block: np.ndarray) -> np.ndarray:
            x = centre(block, sums, n)
            u = x @ p
            return np.concatenate([x.T @ u, (x @ a_basis).T @ u, [u @ u]])

        got = summed(rows, "double", dims + a_basis.shape[1] + 1, part, dims)
        return got[:dims], got[dims:-1], float(got[-1])

    values, vectors = bidiagonalise(product, dims, min(components, dims))
    kept = int(np.sum(values > max(n, dims) * np.finfo(float).eps * values[0])) if values[0] > 0 else 0
    kept = min(kept, components, dims, n - 1)
    if not kept:
        release(rows)
        return df.sparkSession.createDataFrame([], out)
    axes = vectors[:, :kept]
    axes = axes * np.where(axes[np.argmax(abs(axes), axis=0), np.arange(kept)] < 0, -1.0, 1.0)
    deviations = values[:kept] / np.sqrt(n)

    def project(block: np.ndarray) -> np.ndarray:
        return centre(block, sums, n) @ axes / deviations

    def moments(block: np.ndarray) -> np.ndarray:
        x, w = centre(block, sums, n), project(block)
        return np.concatenate([[np.sum(x * x)], w.sum(axis=0), (w.T @ w).ravel()])

    moment = summed(rows, "double", 1 + kept + kept * kept, moments, dims)
    trace, means = moment[0] / n, moment[1 : kept + 1] / n
    covariance = moment[kept + 1 :].reshape(kept, kept) / n - np.outer(means, means)
    error = float(np.max(abs(covariance - np.eye(kept))))
    explained = deviations**2 / trace

    def deviation(block: np.ndarray) -> list[int | None]:
        near = block - sums // n
        size = np.sum((n * near.astype(float)) ** 2, axis=1)
        far = n * near - sums % n  # n x - S, whole; wraps only where the sum does not fit anyway
        out = (far * far).sum(axis=1).tolist()
        for i in np.flatnonzero(size > 2.0**61):
            exact = sum((n * int(c) - int(s)) ** 2 for c, s in zip(block[i], sums)) if size[i] < 2.0**65 else 2**63
            out[i] = exact if exact < 2**63 else None
        return out

    names = free_names(df.select(key), "component", "n", "deviation", "whitened", "explained", "identity_error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = matrix(batch.column(1), dims)
            for at in range(0, len(block), BLOCK):
                part = block[at : at + BLOCK]
                m = len(part)
                which = pa.array(np.repeat(np.arange(at, at + m), kept))
                own = pa.array(deviation(part), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(which), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * kept, n)), own.take(pa.array(np.repeat(np.arange(m), kept))),
                    pa.array(project(part).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error)),
                ], [key, *names])

    fields = out.split(", ")
    schema = ", ".join([fields[0], *(f"{name} {f.split()[1]}" for name, f in zip(names, fields[1:]))])
    return rows.select(key, "x").mapInArrow(run, schema)
