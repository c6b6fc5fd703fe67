"""Whitened embeddings: leading components of the covariance by Jacobi-Davidson."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import gathered, matrix, usual_size, whole

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Vectors searched for beyond those wanted: they part the last wanted one from the rest.
GUARD = 4
#: Basis vectors, in wanted blocks, before a restart; MINRES steps of a correction; outer steps.
WIDTH, INNER, OUTER = 6, 4, 200
#: Bytes of a block of vectors; rows that come back at once.
BLOCK_BYTES, ROWS = 1 << 20, 4096
#: Entries whose whole number is beyond this take no part with their row: sums of them would not fit a long.
LARGEST = 1 << 31
EPS = float(np.finfo(np.float64).eps)

Product = Callable[[np.ndarray], np.ndarray]


def whiten(
    rows: DataFrame, *, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Per remaining row and component: ``id_col, component, n, deviation, whitened, explained, identity_error``.

    An entry c becomes ``x = floor(scale * c) + shift``.  Rows whose vector is null or holds a
    null or non-finite entry go; so do vectors of another length than most have (the longer
    of equally frequent ones) and those with an x beyond 2**31.  The rest, repeats and null ids
    included, are the n vectors fitted on, with sums S.

    The covariance V of x is never formed: a product ``V W`` is one pass over blocks of
    vectors, ``sum((x - S/n) ((x - S/n)' W)) / n``, where ``x - S/n`` comes from the whole number
    ``n x - S``.  The driver holds basis vectors only.  Components are V's leading
    unit eigenvectors, by falling eigenvalue e; ``whitened`` is x - S/n along one, over
    ``sqrt(e)``; ``explained`` is e / trace(V).  Fewer than ``components`` come back where
    fewer e differ from zero (fewer dimensions, few or equal vectors); none, and so no rows,
    for one vector or an empty table.

    ``deviation`` is ``sum((n x - S) ** 2)``, exact, as decimal(38, 0); ``identity_error`` the largest
    absolute entry of the whitened values' covariance, summed over the written rows' own blocks,
    minus the identity.  Other columns are not read.
    """
    made = rows.select(F.col(id_col).alias("id"), whole(F.col(vector_col), scale, shift).alias("x")).filter("x IS NOT NULL")
    made = stored(made.filter(F.forall("x", lambda v: F.abs(v - F.lit(shift)) <= LARGEST)), "whole-vectors")
    dim = usual_size(made, "x")
    fitted = made.filter(F.size("x") == dim)
    blocks = stored(_blocks(fitted, dim), "vector-blocks")
    n, sums = _sums(blocks, dim)
    found = _leading(blocks, n, sums, min(components, dim))
    if found is None:
        return rows.sparkSession.createDataFrame([], _schema(rows, id_col))
    values, vectors, trace = found
    error = _identity_error(blocks, n, sums, vectors / np.sqrt(values))
    return _projected(fitted, n, sums, values, vectors, trace, error, _schema(rows, id_col))


def _schema(rows: DataFrame, id_col: str) -> str:
    kind = rows.schema[id_col].dataType.simpleString()
    return f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _blocks(fitted: DataFrame, dim: int) -> DataFrame:
    """``rows, sums, x``: vectors packed as 64-bit numbers, about BLOCK_BYTES a block, with their sums."""
    most = max(1, BLOCK_BYTES // (8 * max(dim, 1)))

    def pack(batches) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, most):
            x = matrix(part.column(0), dim).astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {"rows": pa.array([len(x)], pa.int64()), "sums": [x.sum(axis=0).tolist()], "x": pa.array([x.tobytes()], pa.binary())}
            )

    return fitted.select("x").mapInArrow(pack, "rows long, sums array<long>, x binary") if dim else fitted.sparkSession.createDataFrame(
        [], "rows long, sums array<long>, x binary"
    )


def _sums(blocks: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """How many vectors there are, and their exact sum."""
    n = blocks.agg(F.sum("rows")).first()[0] or 0
    sums = np.zeros(dim, np.int64)
    for at, total in blocks.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s")).collect():
        sums[at] = total
    return n, sums


def _centred(batch: pa.RecordBatch, n: int, sums: np.ndarray) -> Iterator[np.ndarray]:
    """The centred vectors of each block of a batch."""
    for block in batch.column(0):
        x = np.frombuffer(block.as_buffer(), np.int64).reshape(-1, len(sums))
        yield (n * x - sums) / n


def _summed(blocks: DataFrame, n: int, sums: np.ndarray, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all blocks of a small matrix that ``part`` makes of centred vectors: one row an entry and task moves."""
    def each(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for c in _centred(batch, n, sums):
                total += part(c)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["at", "v"])

    out = np.zeros(shape[0] * shape[1])
    for at, v in blocks.select("x").mapInArrow(each, "at long, v double").groupBy("at").agg(F.sum("v")).collect():
        out[at] = v
    return out.reshape(shape)


def _leading(blocks: DataFrame, n: int, sums: np.ndarray, wanted: int):
    """Leading eigenvalues, unit eigenvectors as columns, and the trace; None if nothing varies."""
    if n < 2 or not wanted:
        return None
    dim = len(sums)
    trace = float(_summed(blocks, n, sums, lambda c: np.array([[np.square(c).sum()]]), (1, 1))[0, 0]) / n
    if not trace:
        return None

    def product(w: np.ndarray) -> np.ndarray:
        return _summed(blocks, n, sums, lambda c: c.T @ (c @ w), (dim, w.shape[1])) / n

    values, vectors = jacobi_davidson(product, dim, wanted)
    some = values > 1e-12 * max(values[0], trace / dim)
    return (values[some], vectors[:, some], trace) if some.any() else None


def jacobi_davidson(
    product: Product, dim: int, wanted: int, *, guard: int = GUARD, width: int = WIDTH, inner: int = INNER, outer: int = OUTER,
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues and unit eigenvectors of the symmetric operator ``product``.

    A basis grows by corrections t of all Ritz vectors u not yet locked: ``(I - QQ')(A - theta I)(I - QQ') t = -r``
    with Q the locked and the current vectors, solved roughly by MINRES; the
    columns share each product.  A Rayleigh-Ritz step follows, and a
    restart from the best Ritz vectors when the basis is ``width`` blocks wide.  A vector is locked
    when its residual is down to rounding, 8 eps sqrt(dim) of the greatest eigenvalue; the
    search ends when all are, checked by a product of the vectors themselves.
    """
    block = min(dim, wanted + guard)
    rng = np.random.default_rng(11)
    basis = np.linalg.qr(rng.standard_normal((dim, block)))[0]
    image = product(basis)
    for _ in range(outer):
        values, mix = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        values, mix = values[::-1], mix[:, ::-1]
        ritz, ritz_image = basis @ mix, image @ mix
        tolerance = 8 * EPS * np.sqrt(dim) * max(abs(values[0]), np.finfo(float).tiny)
        residual = ritz_image[:, :block] - ritz[:, :block] * values[:block]
        size = np.linalg.norm(residual, axis=0)
        if (size[:wanted] <= tolerance).all():
            fresh = product(ritz[:, :wanted])
            if (np.linalg.norm(fresh - ritz[:, :wanted] * values[:wanted], axis=0) <= tolerance).all():
                return values[:wanted], ritz[:, :wanted]
            # Sums of many restarts have drifted: images anew.
            ritz_image[:, :wanted] = fresh
            residual = ritz_image[:, :block] - ritz[:, :block] * values[:block]
            size = np.linalg.norm(residual, axis=0)
        if basis.shape[1] + block > min(dim, width * block) and basis.shape[1] < dim:
            keep = min(2 * block, basis.shape[1])
            basis, image = ritz[:, :keep], ritz_image[:, :keep]
        open_ = np.flatnonzero(size > tolerance)
        locked = ritz[:, :block]
        step = _corrections(product, locked, values[open_], -residual[:, open_], inner)
        new = _beside(basis, np.concatenate([step, residual[:, open_]], axis=1), rng)[:, : max(0, dim - basis.shape[1])]
        if not new.shape[1]:  # the basis is the whole space: only rounding is left
            image = product(basis)
            basis, image = _polished(basis, image)
            continue
        basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, product(new)], axis=1)
    raise ArithmeticError(f"residuals {size[:wanted]} are not down to rounding after {outer} steps")


def _polished(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A basis made orthonormal to rounding again, with its image."""
    q, r = np.linalg.qr(basis)
    return q, np.linalg.solve(r.T, image.T).T


def _beside(basis: np.ndarray, more: np.ndarray, rng) -> np.ndarray:
    """Orthonormal vectors that add what ``more`` has outside ``basis``."""
    kept = np.empty((len(basis), 0))
    for column in more.T:
        norm = np.linalg.norm(column)
        if not norm:
            continue
        v = column / norm
        for _ in range(3):
            v = v - basis @ (basis.T @ v) - kept @ (kept.T @ v)
            if (left := np.linalg.norm(v)) < 1e-10:
                break
            v = v / left
        else:
            kept = np.concatenate([kept, v[:, None]], axis=1)
    return kept


def _corrections(product: Product, locked: np.ndarray, shifts: np.ndarray, right: np.ndarray, steps: int) -> np.ndarray:
    """MINRES for ``(I - QQ')(A - shift I)(I - QQ') t = right``, a column each, side by side."""
    def beside(w: np.ndarray) -> np.ndarray:
        return w - locked @ (locked.T @ w)

    def applied(w: np.ndarray) -> np.ndarray:
        w = beside(w)
        return beside(product(w) - w * shifts)

    right = beside(right)
    beta = np.linalg.norm(right, axis=0)
    first = np.where(beta > 0, beta, 1.0)
    old, v = np.zeros_like(right), right / first
    t, d_old, d = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    phi, beta_next = beta.copy(), np.zeros_like(beta)
    c, s, c_old, s_old = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    live = beta > 0
    for _ in range(steps):
        # Lanczos: one new column of the tridiagonal matrix.
        w = applied(v)
        alpha = (v * w).sum(axis=0)
        w = w - v * alpha - old * beta_next
        last = beta_next
        beta_next = np.linalg.norm(w, axis=0)
        # The two rotations before, then the one that removes beta_next.
        epsilon, rest = s_old * last, c_old * last
        delta, gamma = c * rest + s * alpha, c * alpha - s * rest
        rho = np.hypot(gamma, beta_next)
        live = live & (rho > 1e-14 * (np.abs(alpha) + last + beta_next))
        safe = np.where(live, rho, 1.0)
        c_old, s_old = c, s
        c, s = gamma / safe, beta_next / safe
        d_old, d = d, (v - d * delta - d_old * epsilon) / safe
        t = t + np.where(live, c * phi, 0.0) * d
        phi = -s * phi
        old, v = v, w / np.where(beta_next > 0, beta_next, 1.0)
        live = live & (beta_next > 0)
        if not live.any():
            break
    return beside(t)


def _identity_error(blocks: DataFrame, n: int, sums: np.ndarray, along: np.ndarray) -> float:
    """Largest entry of the covariance of ``centred @ along``, less the identity."""
    k = along.shape[1]

    def part(c: np.ndarray) -> np.ndarray:
        w = c @ along
        return np.concatenate([w.T @ w, w.sum(axis=0, keepdims=True)])

    total = _summed(blocks, n, sums, part, (k + 1, k)) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def _projected(fitted, n, sums, values, vectors, trace, error, schema) -> DataFrame:
    k, dim = len(values), len(sums)
    along, share = vectors / np.sqrt(values), values / trace

    def project(batches) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, ROWS):
            whole_ = n * matrix(part.column(1), dim).astype(np.int64) - sums
            m = len(whole_)
            exact = whole_ if float(np.abs(whole_).max()) ** 2 * dim < 2.0**62 else whole_.astype(object)
            squares = pa.array([str(v) for v in (exact * exact).sum(axis=1)], pa.string())
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    squares.take(each), pa.array(((whole_ / n) @ along).reshape(-1)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = fitted.schema["id"].dataType.simpleString()
    made = fitted.mapInArrow(project, f"id {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double")
    name = fitted.sparkSession.createDataFrame([], schema).columns[0]
    return made.select(F.col("id").alias(name), "component", "n", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "explained", "identity_error")
