"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.llm.common import staged
from fluxloom.llm.vectors import usable

#: Rows multiplied at once. Products of two limbs of LIMB bits, summed over BLOCK rows, are exact in a double.
BLOCK, LIMB = 4096, 20


def pivoted_cholesky(a: np.ndarray, tolerance: float = 1e-13) -> np.ndarray:
    """F (rows as in ``a``, one column per pivot) with F F' = a, for a positive semidefinite ``a``.

    The largest remaining diagonal entry is the next pivot; it ends where that falls to ``tolerance`` of the
    first, so the number of columns is the rank.
    """
    left = np.array(a, float)
    columns, first = [], left.diagonal().max(initial=0.0)
    for _ in range(len(left)):
        p = int(left.diagonal().argmax())
        if left[p, p] <= tolerance * first or left[p, p] <= 0:
            break
        column = left[:, p] / np.sqrt(left[p, p])
        left -= np.outer(column, column)
        left[p, :] = left[:, p] = 0.0
        columns.append(column)
    return np.array(columns).T.reshape(len(left), len(columns))


def one_sided_jacobi(f: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of f f'.

    Columns of ``f`` are rotated pairwise until all are orthogonal. In each step of a round robin the pairs
    are disjoint and turn together. Squared norms are then the eigenvalues, normalised columns the vectors.
    """
    f = np.array(f, float)
    n = f.shape[1]
    order = np.arange(n + n % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(order) - 1):
            i, j = order[: len(order) // 2], order[len(order) // 2 :][::-1]
            real = (i < n) & (j < n)
            i, j = i[real], j[real]
            a, b = f[:, i], f[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(ab) > tolerance * np.sqrt(aa * bb)
            if turn.any():
                turned = True
                i, j, a, b = i[turn], j[turn], a[:, turn], b[:, turn]
                z = (bb[turn] - aa[turn]) / (2 * ab[turn])
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                f[:, i], f[:, j] = c * (a - t * b), c * (t * a + b)
            order[1:] = np.roll(order[1:], 1)
        if not turned:
            break
    norms = np.sqrt((f * f).sum(0))
    by = np.argsort(-norms, kind="stable")
    return norms[by] ** 2, f[:, by] / norms[by]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of long; shorter vectors are filled up with zeros."""
    lengths = np.asarray(pa.compute.list_value_length(column), np.int64)
    out = np.zeros((len(column), width), np.int64)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(column)), lengths), at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _gram(fit: DataFrame, near_mean: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums and products of x minus the mean rounded to integers, over all rows of ``fit``.

    Each task multiplies limbs of its rows in blocks that doubles hold exactly and sends one number per pair
    of components, so the result does not depend on how rows are dealt.
    """
    width = len(near_mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, grams = {}, {}
        for block in _blocks(batches, BLOCK):
            y = _matrix(block.column(0), width) - near_mean
            size = max(1, -(-int(np.abs(y).max(initial=0)).bit_length() // LIMB))
            limbs = [((np.abs(y) >> (LIMB * k)) & ((1 << LIMB) - 1)) * np.sign(y) for k in range(size)]
            for k, a in enumerate(limbs):
                sums[k] = sums.get(k, 0) + a.sum(axis=0)
                for m, b in enumerate(limbs):
                    grams[k + m] = grams.get(k + m, 0) + (a.T.astype(float) @ b.astype(float)).astype(np.int64)
        for k, s in sums.items():
            yield _entries(k, np.full(width, -1), np.arange(width), s)
        for k, g in grams.items():
            i, j = np.tril_indices(width)
            yield _entries(k, i, j, g[i, j])

    parts = fit.mapInArrow(run, "k int, i int, j int, value long").groupBy("k", "i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    sums, gram = [0] * width, [[0] * width for _ in range(width)]
    for k, i, j, value in parts.collect():
        if i < 0:
            sums[j] += int(value) << (LIMB * k)
        else:
            gram[i][j] += int(value) << (LIMB * k)
            gram[j][i] = gram[i][j]
    return sums, gram


def _entries(k: int, i: np.ndarray, j: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(i), k), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["k", "i", "j", "value"])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in doubles, each entry rounded once as long as n x fits a long."""
    if n * int(np.abs(x).max(initial=0)) < 2**62 and max(map(abs, sums), default=0) < 2**62:
        return (n * x - np.array(sums, np.int64)) / n
    return np.array([[(n * int(v) - s) / n for v, s in zip(row, sums, strict=True)] for row in x]).reshape(x.shape)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sum of (n x - S)^2 per row; in whole numbers of any size where a long might not hold it."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * max(1, x.shape[1]) < 2**63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    found = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    if max(found, default=0) >= 2**63:
        raise ArithmeticError("a deviation does not fit a long")
    return found


def whiten(
    vectors: DataFrame, components: int = 4, vec_id: str = "vec_id", vec: str = "embedding", scale: int = 256
) -> DataFrame:
    """Coordinates along the leading components, scaled to unit variance, one row per vector and component:
    (vec_id, component, n, deviation, whitened, explained, identity_error).

    Vectors are first scaled to integers x = floor(scale * c). The fit list is each distinct x once: n vectors
    with sums S. Their covariance is summed exactly around the mean rounded to integers, in tasks; what
    reaches the driver is one number per pair of components. There pivoted Cholesky factors it and one-sided
    Jacobi turns the factor's columns until they are orthogonal. Signs are fixed: a component's largest entry
    is positive. ``identity_error`` is measured over the fit list in a second pass.

    Vectors that are null or hold null, NaN or infinite entries are left out; an empty vector and missing
    entries of shorter ones count as zeros; repeated rows and null ids are returned like any others. There
    are at most as many components as the rank of the covariance, so a single distinct vector, or no vector
    at all, gives no rows. Entries beyond a long, and deviations beyond one, raise ArithmeticError. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    x = F.transform(F.col(vec).cast("array<double>"), lambda c: F.floor(c * scale))
    large = F.exists(F.col(vec).cast("array<double>"), lambda c: F.abs(c * scale) >= float(2**63))
    sound = vectors.where(usable(F.col(vec))).select(F.col(vec_id).alias("vec_id"), x.alias("x"), large.alias("large"))
    rows = staged(sound, "vectors")
    width, over = rows.agg(F.max(F.size("x")), F.max("large")).first()
    if over:
        raise ArithmeticError("an entry does not fit a long")
    width = width or 0
    if not width:
        return spark.createDataFrame([], SCHEMA)
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    fit = staged(rows.select(filled.alias("x")).distinct(), "fit")
    first = fit.agg(F.count("*").alias("n"), *[F.sum(F.element_at("x", i + 1).cast("decimal(38,0)")) for i in range(width)]).first()
    n, sums = int(first[0]), [int(s) for s in first[1:]]
    near_mean = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest, gram = _gram(fit, near_mean)
    # n^2 times the covariance, in whole numbers: nothing is lost before the one division.
    covariance = np.array([[(n * g - a * b) / (n * n) for g, b in zip(row, rest, strict=True)] for row, a in zip(gram, rest, strict=True)])
    values, axes = one_sided_jacobi(pivoted_cholesky(covariance))
    values, axes = values[:components], axes[:, :components]
    explained = values / covariance.trace() if len(values) else values
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    project = axes / np.sqrt(values)
    count = len(values)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, count))
        for block in _blocks(batches, BLOCK):
            w = _centred(_matrix(block.column(0), width), n, sums) @ project
            total += w.T @ w
        i, j = np.tril_indices(count)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "value"])

    sums_of = fit.mapInArrow(products, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect() if count else []
    error = max((abs(value / n - (i == j)) for i, j, value in sums_of), default=0.0)

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, BLOCK):
            x = _matrix(block.column(1), width)
            w = _centred(x, n, sums) @ project
            each = np.repeat(np.arange(len(x)), count)
            columns = [
                block.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()),
                pa.array(np.full(len(each), n), pa.int64()),
                pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                pa.array(w.ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    schema = SCHEMA.replace("vec_id long", f"vec_id {rows.schema['vec_id'].dataType.simpleString()}")
    return rows.select("vec_id", "x").mapInArrow(coordinates, schema)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
NAMES = [field.split()[0] for field in SCHEMA.split(", ")]
