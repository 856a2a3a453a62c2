"""Whitening of embeddings on their leading principal components (block Jacobi-Davidson).

Entries become exact integers, ``floor(64 * c) + 1000000``. The covariance of the
n vectors is never formed: a product with a block of vectors is one pass of Spark
over the rows, each centred exactly (n * x - S in integers, then divided by n)
before it is multiplied, with the partial sums added in two steps. On top of it:

* *Rayleigh-Ritz* in a small subspace gives Ritz pairs and residuals.
* *Locking*: pairs whose residual has reached double precision get no further
  corrections, but stay in the subspace.
* The others get a correction each: (I - UU')(V - e I)(I - UU') t = -r, solved
  inexactly by a few *MINRES* steps. All equations step together, so that one
  pass serves all of them; corrections enlarge the subspace, which is cut back to
  the best Ritz vectors when it grows over ``SPACE`` times the wanted ones.

It ends when every wanted residual is at most ``TOLERANCE`` times the largest
eigenvalue. The driver holds a few (dimension x subspace) matrices, whose size
depends on the vectors' length alone, never on their number.

Edge cases: vectors that are null or hold a null or non-finite entry are dropped;
a shorter vector lacks trailing entries, which count as 0.0; repeated rows count
each; a null vec_id stays null; components whose eigenvalue is 0 to double
precision have no whitened values and are not returned (so one vector, or equal
ones, give no components); a null or empty table gives no rows; very long vectors
are worked on in blocks of ``BLOCK_ENTRIES`` entries; other columns stay, added
ones start with ``_``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agendum.llm.storage import cut, ship_code

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
TOLERANCE = 64 * np.finfo(float).eps
EXTRA = 8             # vectors of the first subspace beyond the wanted ones
SPACE = 3             # subspace over wanted components before it is cut back
INNER = 6             # MINRES steps of a correction
MAX_OUTER = 100
BLOCK_ENTRIES = 1 << 21
MERGERS = 16          # tasks that add up partial sums


def integers(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """The remaining rows with ``_y``: floor(64 * c) of each entry (that is x - SHIFT)."""
    x = F.col(embedding)
    fine = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf"))), F.lit(False))
    return vectors.where(x.isNotNull() & fine).withColumn("_y", F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long")))


def _blocks(col: pa.Array, dims: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row + 1, integer matrix) of bounded size, short vectors filled up."""
    rows = max(1, BLOCK_ENTRIES // max(dims, 1))
    for lo in range(0, len(col), rows):
        part = col.slice(lo, rows)
        size = np.diff(part.offsets.to_numpy())
        flat = part.flatten().to_numpy()
        if (size == dims).all():
            yield lo, lo + len(part), flat.reshape(len(part), dims)
            continue
        out = np.zeros((len(part), dims), np.int64)
        out[np.arange(dims) < size[:, None]] = flat
        yield lo, lo + len(part), out


def _exact(y: np.ndarray, factor: int = 1) -> np.ndarray:
    """``y`` ready for exact squares and sums: Python integers where 64 bits could overflow."""
    top = int(np.abs(y).max(initial=0)) * factor
    return y if top * top * max(y.shape) < 1 << 62 else y.astype(object)


SUMS = pa.schema([("dim", pa.int32()), ("y", pa.decimal128(38, 0)), ("yy", pa.decimal128(38, 0))])


@dataclass
class Whitening:
    """Exact sums of the fit and its leading eigenpairs."""
    n: int
    sums: list[int]                    # of y, by dimension
    trace: float
    values: np.ndarray
    vectors: np.ndarray                # dimension x component
    residuals: np.ndarray = field(default_factory=lambda: np.zeros(0))
    products: int = 0

    @property
    def dims(self) -> int:
        return len(self.sums)

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * y - sums, exact."""
        z = _exact(y, 2 * self.n) * self.n
        return z - np.array(self.sums, z.dtype)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return self.centred(y).astype(float) / self.n @ self.vectors / np.sqrt(self.values)


def _totals(data: DataFrame, dims: int) -> tuple[int, list[int], list[int]]:
    """Number of rows, and sums of y and y * y by dimension (as many rows as dimensions)."""
    def run(batches):
        for batch in batches:
            for _, _, y in _blocks(batch.column(0), dims):
                y = _exact(y)
                yield pa.record_batch([pa.array(np.arange(dims, dtype=np.int32)), pa.array([int(v) for v in y.sum(axis=0)], pa.decimal128(38, 0)),
                                       pa.array([int(v) for v in (y * y).sum(axis=0)], pa.decimal128(38, 0))], schema=SUMS)
    rows = data.select("_y").mapInArrow(run, "dim int, y decimal(38,0), yy decimal(38,0)").groupBy("dim").agg(F.sum("y").alias("y"), F.sum("yy").alias("yy")).collect()
    rows.sort(key=lambda r: r["dim"])
    return data.count(), [int(r["y"]) for r in rows], [int(r["yy"]) for r in rows]


def _sum_over_rows(data: DataFrame, dims: int, partial: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum of ``partial(y block)`` over all rows: a task's blocks, then tasks, in a fixed order."""
    def local(batches):
        total = np.zeros(shape)
        for batch in batches:
            for _, _, y in _blocks(batch.column(0), dims):
                total += partial(y)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["m"])

    def merge(rows: pa.Table) -> pa.Table:
        parts = rows.sort_by("task").column("m").to_pylist()
        return pa.table({"task": rows.column("task").slice(0, 1), "m": [np.sum([np.frombuffer(p) for p in parts], axis=0).tobytes()]})

    parts = data.select("_y").mapInArrow(local, "m binary").withColumn("task", F.spark_partition_id())
    merged = parts.groupBy(F.pmod("task", F.lit(MERGERS))).applyInArrow(merge, "task int, m binary").collect()
    total = np.zeros(shape)
    for row in sorted(merged, key=lambda r: r["task"]):
        total += np.frombuffer(row["m"]).reshape(shape)
    return total


def minres(product: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, reduction: float) -> np.ndarray:
    """``steps`` MINRES steps on A t = b for all columns at once, fewer when every
    residual fell by ``reduction``. ``product`` gives A times a block, each column
    with its own operator."""
    norm = np.linalg.norm(b, axis=0)
    beta = np.where(norm > 0, norm, 1)
    v_old, v = np.zeros_like(b), b / beta
    x, d, d_old = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    c = c_old = np.ones(b.shape[1])
    s = s_old = np.zeros(b.shape[1])
    eta, beta_here = norm.copy(), np.zeros(b.shape[1])
    for _ in range(steps):
        w = product(v)
        alpha = (v * w).sum(axis=0)
        w = w - alpha * v - beta_here * v_old
        beta_next = np.linalg.norm(w, axis=0)
        # The last two rotations on the new column of the tridiagonal matrix, then a new one.
        rho3, rho2 = s_old * beta_here, c * c_old * beta_here + s * alpha
        delta = c * alpha - s * c_old * beta_here
        rho1 = np.hypot(delta, beta_next)
        safe = np.where(rho1 > 0, rho1, 1)
        c_old, s_old, c, s = c, s, delta / safe, beta_next / safe
        d, d_old = (v - rho3 * d_old - rho2 * d) / safe, d
        d = np.where(rho1 > 0, d, 0)
        x = x + c * eta * d
        eta = -s * eta
        v_old, v = v, np.where(beta_next > 0, w / np.where(beta_next > 0, beta_next, 1), 0)
        beta_here = beta_next
        if (np.abs(eta) <= reduction * norm).all():
            break
    return x


def orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of ``block`` beside ``basis``; what ``basis`` holds already is left out."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(3):
        block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10]
    return block


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 13):
    """(values, vectors, residual norms) of the ``wanted`` largest eigenvalues of
    the symmetric operator ``product``."""
    wanted = min(wanted, dims)
    basis = orthonormal(np.random.default_rng(seed).normal(size=(dims, min(dims, wanted + EXTRA))), np.zeros((dims, 0)))
    image = product(basis)
    for _ in range(MAX_OUTER):
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        turn = turn[:, ::-1]
        basis, image, values = basis @ turn, image @ turn, values[::-1]
        u, e = basis[:, :wanted], values[:wanted]
        r = image[:, :wanted] - u * e
        size = np.linalg.norm(r, axis=0)
        open_ = size > TOLERANCE * max(e[0], 0)
        if not open_.any() or basis.shape[1] == dims:
            return e, u, size
        if basis.shape[1] + open_.sum() > max(SPACE * wanted, wanted + EXTRA):
            basis, image = basis[:, :wanted + EXTRA], image[:, :wanted + EXTRA]
        away = lambda m: m - u @ (u.T @ m)  # noqa: E731, B023
        shift = e[open_]
        step = lambda m: away(product(away(m)) - away(m) * shift)  # noqa: E731, B023
        more = orthonormal(minres(step, -away(r[:, open_]), INNER, 0.05), basis)
        if not more.shape[1]:
            more = orthonormal(r[:, open_], basis)
        if not more.shape[1]:
            return e, u, size
        basis, image = np.hstack([basis, more]), np.hstack([image, product(more)])
    raise RuntimeError(f"residuals did not reach double precision: {size.max() / e[0]:.2e} of the largest eigenvalue")


def fit(data: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all rows of ``data`` (see ``integers``); None without any row."""
    ship_code(data.sparkSession)
    dims = data.agg(F.max(F.size("_y"))).first()[0]
    if dims is None:
        return None
    n, sums, squares = _totals(data, dims)
    trace = float(sum((Fraction(n * q - s * s, n * n) for s, q in zip(sums, squares, strict=True)), Fraction(0)))
    model = Whitening(n, sums, trace, np.zeros(0), np.zeros((dims, 0)))
    if not trace:
        return model

    def product(block: np.ndarray) -> np.ndarray:
        model.products += 1

        def partial(y: np.ndarray) -> np.ndarray:
            z = centred(y).astype(float) / n
            return z.T @ (z @ block)
        centred = Whitening(n, sums, trace, np.zeros(0), np.zeros((dims, 0))).centred
        return _sum_over_rows(data, dims, partial, block.shape) / n

    values, vectors, residuals = leading_pairs(product, dims, components)
    real = values > dims * TOLERANCE * values[0]
    model.values, model.vectors, model.residuals = values[real], vectors[:, real], residuals[real]
    return model


def identity_error(data: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(model.values)

    def partial(y: np.ndarray) -> np.ndarray:
        w = model.whitened(y)
        return np.vstack([w.T @ w, w.sum(axis=0)])
    total = _sum_over_rows(data, model.dims, partial, (k + 1, k)) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max(initial=0))


def transform(data: DataFrame, model: Whitening) -> DataFrame:
    """``data`` without ``_y``, with ``_deviation`` (exact squared distance from the
    mean, times n * n; decimal) and ``_whitened`` (array, by component)."""
    k, dims = len(model.values), model.dims
    names = [c for c in data.columns if c != "_y"]

    def run(batches):
        for batch in batches:
            for lo, hi, y in _blocks(batch.column(batch.num_columns - 1), dims):
                z = model.centred(y)
                squares = [int(v) for v in (z * z).sum(axis=1)] if z.dtype != object else [sum(v * v for v in row) for row in z]
                w = z.astype(float) / model.n @ model.vectors / np.sqrt(model.values)
                whitened = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * k), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], pa.array(squares, pa.decimal128(38, 0)), whitened],
                                                 names=[*names, "_deviation", "_whitened"])
    schema = data.select(names).withColumns({"_deviation": F.lit(None).cast("decimal(38,0)"), "_whitened": F.lit(None).cast("array<double>")}).schema
    return data.select(*[F.col(f"`{c}`") for c in names], "_y").mapInArrow(run, schema)


def whiten(vectors: DataFrame, components: int = COMPONENTS, embedding: str = "embedding") -> tuple[DataFrame, Whitening | None]:
    """(rows with ``_deviation`` and ``_whitened``, model) of the remaining rows."""
    data = cut(integers(vectors, embedding), "whitening-integers")
    model = fit(data, components)
    if model is None:
        none = data.withColumns({"_deviation": F.lit(None).cast("decimal(38,0)"), "_whitened": F.array().cast("array<double>")})
        return none.drop("_y"), None
    return transform(data, model), model


def by_component(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one
    row per remaining vector and component."""
    data = cut(integers(vectors.select("vec_id", "embedding")).drop("embedding"), "whitening-integers")
    model = fit(data, components)
    if model is None or not len(model.values):
        empty = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return data.sparkSession.createDataFrame([], empty)
    error = identity_error(data, model)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    rows = transform(data, model).select("vec_id", "_deviation", F.posexplode("_whitened").alias("place", "whitened"))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("_deviation").alias("deviation"),
                       "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))
