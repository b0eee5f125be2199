"""Embedding whitening with the leading eigenvectors of the covariance, found by a block Jacobi-Davidson method.

The covariance is never formed. It is known only by its product with a block of vectors, one Spark job over the distinct
centred rows: every task multiplies its rows and adds up one block, and the blocks are added by dimension in a shuffle, so the
driver holds dimensions times block numbers and nothing that grows with the rows.

The search space is extended by the corrections of all pairs that have not converged: each solves its projected correction
equation ``(I - QQ') (V - theta I) (I - QQ') t = -r`` by a few steps of MINRES, all in lockstep, so a step of the whole block is one
job. Rayleigh-Ritz on the search space gives the next pairs. A pair is locked, and kept out of the search space, when its
residual reaches double precision; the search space restarts from the best Ritz vectors when it is full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacast.session import stage

COMPONENTS = 16
SCALE = 64
SHIFT = 1_000_000
#: Pairs that are followed besides those wanted, so that close eigenvalues are told apart early.
GUARD = 4
INNER_STEPS = 5
#: Size of the search space, in blocks, before it restarts.
BLOCKS = 6
MOST_STEPS = 60
#: A residual counts as double precision at this many units of the last place of the largest eigenvalue, per root of the dimension.
LAST_PLACES = 8
#: Eigenvalues below this share of the trace are rounding, not variance.
LEAST_SHARE = 1e-13
LARGEST = 1 << 46
#: Numbers that a task holds centred at a time.
SLICE = 1 << 20

Product = Callable[[np.ndarray], np.ndarray]


def integer_rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, x)``: rows whose vector has finite entries only, as shifted integers; entries beyond 2^46 are cut to it."""
    entries = F.col(vector)
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = F.transform(
        entries,
        lambda c: (F.greatest(F.least(F.floor(c.cast("double") * SCALE).cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long") + SHIFT,
    )
    return vectors.where(F.coalesce(finite & (F.size(entries) > 0), F.lit(False))).select(F.col(key).alias("id"), scaled.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass(frozen=True)
class Centre:
    """Count and sums of the fit rows, and centred rows from them."""

    n: int
    sums: np.ndarray  # sums of x - SHIFT by dimension

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n x - S``, exact: the shift leaves it as it is."""
        small = x - SHIFT
        if len(small) and self.n * int(np.abs(small).max()) + int(np.abs(self.sums).max()) >= 1 << 62:
            return small.astype(object) * self.n - self.sums.astype(object)
        return small * np.int64(self.n) - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n`` to the last place, as one division of the exact difference."""
        return (self.deviations(x) / self.n).astype(np.float64)


def fit_centre(fit: DataFrame, width: int) -> Centre:
    """Count and per-dimension sums of the distinct rows."""
    entries = fit.select(F.posexplode("x").alias("place", "entry"))
    by_place = entries.groupBy("place").agg(F.count("*").alias("n"), F.sum((F.col("entry") - SHIFT).cast("decimal(38,0)")).alias("sum"))
    rows = sorted(by_place.collect())
    sums = [int(r["sum"]) for r in rows]
    kind = np.int64 if max(map(abs, sums), default=0) < 1 << 62 else object
    return Centre(rows[0]["n"] if rows else 0, np.array(sums, kind) if rows else np.zeros(width, np.int64))


def _added(blocks: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sum of the tasks' blocks ``(place, row)``, added up by place in a shuffle."""
    columns = [F.sum(F.get("row", F.lit(j))).alias(f"c{j}") for j in range(shape[1])]
    out = np.zeros(shape)
    for r in blocks.groupBy("place").agg(*columns).collect():
        out[r[0]] = r[1:]
    return out


def _block_sum(fit: DataFrame, width: int, columns: int, height: int, partial: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``partial`` of some rows, a block of ``height`` by ``columns``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, columns))
        for batch in batches:
            for start in range(0, batch.num_rows, max(1, SLICE // width)):
                total += partial(_matrix(batch.column(0).slice(start, max(1, SLICE // width)), width))
        rows = pa.ListArray.from_arrays(np.arange(height + 1, dtype=np.int32) * columns, total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(height), pa.int32()), rows], names=["place", "row"])

    return _added(fit.select("x").mapInArrow(sums, "place int, row array<double>"), (height, columns))


def covariance_product(fit: DataFrame, centre: Centre) -> Product:
    """Product of the covariance of the fit rows with a block of vectors, one job."""
    width = len(centre.sums)

    def product(block: np.ndarray) -> np.ndarray:
        def partial(x: np.ndarray) -> np.ndarray:
            rows = centre.centred(x)
            return rows.T @ (rows @ block)

        return _block_sum(fit, width, block.shape[1], width, partial) / centre.n

    return product


def total_variance(fit: DataFrame, centre: Centre) -> float:
    """Trace of the covariance."""
    return float(_block_sum(fit, len(centre.sums), 1, 1, lambda x: np.square(centre.centred(x)).sum().reshape(1, 1))[0, 0]) / centre.n


def _corrections(product: Product, vectors: np.ndarray, values: np.ndarray, residuals: np.ndarray, locked: np.ndarray, steps: int) -> np.ndarray:
    """MINRES on the projected correction equations of all columns in lockstep; one product a step."""

    def project(block: np.ndarray) -> np.ndarray:
        for _ in range(2):
            block = block - locked @ (locked.T @ block)
            block = block - vectors * (vectors * block).sum(axis=0)
        return block

    def operator(block: np.ndarray) -> np.ndarray:
        return project(product(block) - block * values)

    right = project(-residuals)
    beta = np.linalg.norm(right, axis=0)
    live = beta > 0
    scale = np.where(live, beta, 1.0)
    current, before = right / scale, np.zeros_like(right)
    found, older, newer = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    count = right.shape[1]
    c0, s0, c1, s1 = np.ones(count), np.zeros(count), np.ones(count), np.zeros(count)
    rest, last = beta.copy(), np.zeros(count)
    for _ in range(steps):
        image = operator(current) - before * last
        alpha = (current * image).sum(axis=0)
        image = image - current * alpha
        following = np.linalg.norm(image, axis=0)
        # two earlier rotations, then the one that clears the new entry
        epsilon = s0 * last
        delta = c0 * last
        diagonal = c1 * alpha - s1 * delta
        above = s1 * alpha + c1 * delta
        size = np.hypot(diagonal, following)
        safe = np.where(size > 0, size, 1.0)
        c0, s0, c1, s1 = c1, s1, np.where(size > 0, diagonal / safe, 1.0), np.where(size > 0, following / safe, 0.0)
        direction = (current - older * epsilon - newer * above) / safe
        direction[:, size == 0] = 0
        found = found + direction * (c1 * rest)
        rest = -s1 * rest
        older, newer = newer, direction
        going = following > 1e-14 * scale
        before, current = current, np.where(going, image / np.where(going, following, 1.0), 0.0)
        last = np.where(going, following, 0.0)
    return project(found)


def _orthonormal(block: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of what the block adds to the given orthonormal bases."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(3):
        for basis in against:
            block = block - basis @ (basis.T @ block)
        if not block.shape[1]:
            return block
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, size > 1e-10]
    return block


def leading_pairs(product: Product, width: int, wanted: int, trace: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their vectors; fewer if the rest has no variance.

    Every product is one job; the driver holds the search space only, ``BLOCKS`` blocks of vectors.
    """
    wanted = min(wanted, width)
    block = min(wanted + GUARD, width)
    basis = _orthonormal(np.random.default_rng(seed).normal(size=(width, block)), [])
    image = product(basis)
    locked, values = np.zeros((width, 0)), np.zeros(0)
    for _ in range(MOST_STEPS):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        followed = min(block, len(theta))
        vectors, images = basis @ turn[:, :followed], image @ turn[:, :followed]
        residuals = images - vectors * theta[:followed]
        residuals = residuals - locked @ (locked.T @ residuals)
        largest = max(values.max(initial=0.0), theta[0] if len(theta) else 0.0)
        tolerance = LAST_PLACES * np.finfo(float).eps * np.sqrt(width) * largest
        done = np.linalg.norm(residuals, axis=0) <= tolerance
        complete = basis.shape[1] + locked.shape[1] >= width
        missing = wanted - locked.shape[1]
        # only a leading run is locked, so that no larger pair is passed over
        run = followed if complete else int(np.argmin(np.append(done, False)))
        run = min(run, missing)
        if run:
            locked, values = np.hstack([locked, vectors[:, :run]]), np.append(values, theta[:run])
        if run == missing:
            break
        rest = turn[:, run:]
        if basis.shape[1] >= BLOCKS * block:
            rest = rest[:, : 2 * block]
        basis, image = basis @ rest, image @ rest
        open_ = [i for i in range(run, followed) if not done[i]][: max(width - locked.shape[1] - basis.shape[1], 0)]
        steps = _corrections(product, vectors[:, open_], theta[open_], residuals[:, open_], locked, INNER_STEPS)
        new = _orthonormal(steps, [locked, basis])
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(seed + locked.shape[1] + 1).normal(size=(width, block)), [locked, basis])
        if new.shape[1]:
            basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
    else:
        raise ArithmeticError(f"{locked.shape[1]} of {wanted} pairs reached double precision in {MOST_STEPS} steps")
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > LEAST_SHARE * trace]
    return values[order], locked[:, order]


def identity_error(fit: DataFrame, centre: Centre, weights: np.ndarray) -> float:
    """Largest entry by which the covariance of the whitened fit rows differs from the identity."""
    count = weights.shape[1]

    def partial(x: np.ndarray) -> np.ndarray:
        rows = centre.centred(x) @ weights
        return rows.T @ rows

    return float(np.abs(_block_sum(fit, len(weights), count, count, partial) / centre.n - np.eye(count)).max(initial=0.0))


def _exact_squares(deviations: np.ndarray) -> list[int]:
    if deviations.dtype != object and (not deviations.size or int(np.abs(deviations).max()) ** 2 * deviations.shape[1] < 1 << 63):
        return np.square(deviations).sum(axis=1).tolist()
    return [sum(int(d) ** 2 for d in row) for row in deviations]


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` for every usable row and component.

    Rows whose vector is null, empty or holds null or non-finite entries give nothing; of vectors of several widths the
    width of most rows is used (the wider one of a tie). Components without variance are left out, so a table of equal vectors,
    or an empty one, gives no rows. Repeated rows and keys are kept, a repeated vector counts once in the fit. Other columns are not read. A ``deviation`` that needs
    more than 63 bits is an error.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integer_rows(vectors, key, vector)
    groups = stage(rows.groupBy("x").agg(F.count("*").alias("copies")), "whitening-fit")
    widths = groups.groupBy(F.size("x").alias("width")).agg(F.sum("copies").alias("rows"))
    most = widths.orderBy(F.desc("rows"), F.desc("width")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    width = most["width"]
    fit = groups.where(F.size("x") == width).select("x")
    centre = fit_centre(fit, width)
    trace = total_variance(fit, centre)
    values, directions = leading_pairs(covariance_product(fit, centre), width, components, trace) if trace > 0 else (np.zeros(0), np.zeros((width, 0)))
    if not len(values):
        return spark.createDataFrame([], schema)
    weights = directions / np.sqrt(values)
    error = identity_error(fit, centre, weights)
    count = len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            deviations = centre.deviations(_matrix(batch.column(1), width))
            projected = (deviations / centre.n).astype(np.float64) @ weights
            many = batch.num_rows * count
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), count))),
                    pa.array(np.tile(np.arange(1, count + 1), batch.num_rows), pa.int32()),
                    pa.array(np.full(many, centre.n), pa.int64()),
                    pa.array(_exact_squares(deviations), pa.int64()).take(pa.array(np.repeat(np.arange(batch.num_rows), count))),
                    pa.array(projected.ravel()),
                    pa.array(np.tile(values / trace, batch.num_rows)),
                    pa.array(np.full(many, error)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.size("x") == width).mapInArrow(project, schema)
