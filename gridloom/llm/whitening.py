"""Operator 12: whitening of embeddings by Jacobi-Davidson.

The largest eigenpairs of a covariance are found without ever forming it: a product of the covariance with some vectors is one
Spark job over the centred rows, and only the vectors, as long as an embedding, are on the driver.

* **Subspace.** Rayleigh-Ritz on a growing orthonormal basis, whose products are kept, so restarts cost no job.
* **Correction.** For each wanted pair that is not yet exact, the projected correction equation is solved by some steps of
  MINRES. The solvers of all pairs go on side by side and share one job a step.
* **Locking.** A pair whose residual has reached double precision, as have all before it, is locked; later vectors are kept
  orthogonal to it. It ends when all wanted pairs are locked. Without progress over many rounds it fails.

An entry c becomes floor(256 * c) as long. Components are fitted on the distinct rows; sums are exact integers.

Left out: rows whose vector is null, empty, or holds null or non-finite entries or ones too large for a long; where lengths differ,
rows of other than the commonest length (of equally common ones, the longest). Repeated rows: fitted once, returned each. Ties among
eigenvalues: any basis. Components without variance (a share of the total below 1e-13) are left out, so a table with one distinct
vector has none. A deviation too large for a long is null. Null vec_id: kept. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.shared import stored
from gridloom.llm.common import table

SCALE = 256
COMPONENTS = 4
INNER = 4  # steps of MINRES for one correction
WIDEST = 32  # vectors in the basis before it is cut back
EXACT = 1e-14  # residual, relative to the largest eigenvalue, that counts as double precision
STALLED = 12  # rounds without a smaller residual after which a pair below SETTLED is as exact as sums of doubles allow
SETTLED = 1e-13
NO_VARIANCE = 1e-13
RESULT = (
    "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def scaled(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``x``, the entries as longs, of the rows that count."""
    entry = F.col("embedding")
    usable = F.forall(entry, lambda c: F.coalesce(F.abs(c.cast("double")) < float(2**62 // scale), F.lit(False)))
    rows = embeddings.select("vec_id", "embedding").where((F.size(entry) > 0) & usable)
    lengths = rows.groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n"))
    commonest = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    rows = rows.where(F.size("embedding") == (commonest["length"] if commonest else 0))
    return rows.select("vec_id", F.transform(entry, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added(rows: DataFrame, sums: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
    """Sums over all rows of what ``sums`` gives for a batch (numbers in a row each), added by place."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = sums(_matrix(batch.column(0)))
                total = one if total is None else total + one
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["place", "value"])

    value = F.sum(F.col("value").cast("decimal(38,0)") if kind == "long" else F.col("value"))
    found = rows.select("x").mapInArrow(partial, f"place long, value {kind}").groupBy("place").agg(value.alias("value"))
    return [r["value"] for r in sorted(found.collect())]  # as many numbers as the vectors at hand have


@dataclass(frozen=True)
class Fitted:
    """Exact size and sums of the distinct rows."""

    rows: DataFrame
    n: int
    sums: list[int]
    trace: float

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # a quotient of integers, rounded once

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """Covariance times each column, in one job."""
        mean, n = self.mean(), self.n

        def sums(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ vectors)

        return np.array(_added(self.rows, sums, "double"), float).reshape(vectors.shape) / n


def fit(x: DataFrame) -> Fitted | None:
    rows = stored(x.select("x").distinct(), "distinct-vectors")
    n = rows.count()
    if not n:
        return None

    def sums(m: np.ndarray) -> np.ndarray:
        return m.sum(axis=0)

    exact = [int(v) for v in _added(rows, sums, "long")]
    mean = np.array([s / n for s in exact])
    trace = math.fsum(_added(rows, lambda m: ((m - mean) ** 2).sum(axis=0), "double")) / n
    return Fitted(rows, n, exact, trace)


Solver = Generator[np.ndarray, np.ndarray, np.ndarray]


def minres(right: np.ndarray, theta: float, outside: Callable[[np.ndarray], np.ndarray], steps: int) -> Solver:
    """Approximate t with outside(V - theta)outside t = right; asks for products of V and is sent them."""
    beta = float(np.linalg.norm(right))
    found, v_old, v = np.zeros_like(right), np.zeros_like(right), right / beta
    w_old, w = np.zeros_like(right), np.zeros_like(right)
    c_old, s_old, c, s, eta, b = 1.0, 0.0, 1.0, 0.0, beta, 0.0
    for _ in range(steps):
        u = outside((yield v) - theta * v)
        a = float(v @ u)
        u = outside(u - a * v - b * v_old)
        b_next = float(np.linalg.norm(u))
        r1 = c * a - c_old * s * b
        r2, r3 = s * a + c_old * c * b, s_old * b
        rho = math.hypot(r1, b_next)
        if rho <= 1e-300:
            break
        c_old, s_old, c, s = c, s, r1 / rho, b_next / rho
        w_old, w = w, (v - r3 * w_old - r2 * w) / rho
        found = found + c * eta * w
        eta *= -s
        if b_next <= 1e-14 * beta:
            break
        v_old, v, b = v, u / b_next, b_next
    return found


def _side_by_side(solvers: list[Solver], product: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """What the solvers return; one product serves a step of all that still ask."""
    done: dict[int, np.ndarray] = {}
    asked: dict[int, np.ndarray] = {}

    def go_on(k: int, got: np.ndarray | None) -> None:
        try:
            asked[k] = solvers[k].send(got)
        except StopIteration as end:
            done[k] = end.value

    for k in range(len(solvers)):
        go_on(k, None)
    while asked:
        now = sorted(asked)
        products = product(np.column_stack([asked.pop(k) for k in now]))
        for column, k in enumerate(now):
            go_on(k, products[:, column])
    return [done[k] for k in range(len(solvers))]


def _orthonormal(vectors: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The new directions in ``vectors``: orthogonal to the basis (twice, for full precision) and to each other."""
    kept: list[np.ndarray] = []
    for v in vectors.T:
        size = np.linalg.norm(v)
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
            for u in kept:
                v = v - u * (u @ v)
        if size > 0 and np.linalg.norm(v) > 1e-10 * size:
            kept.append(v / np.linalg.norm(v))
    return np.column_stack(kept) if kept else np.zeros((len(basis), 0))


def jacobi_davidson(
    product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, inner: int = INNER, widest: int = WIDEST
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    wanted = min(wanted, size)
    rng = np.random.default_rng(7)
    basis = _orthonormal(rng.standard_normal((size, min(size, wanted + 4))), np.zeros((size, 0)))
    image = product(basis)
    locked, values = np.zeros((size, 0)), []
    best, since, rounds = np.full(wanted, np.inf), np.zeros(wanted, int), 0
    while True:
        theta, inside = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, inside = theta[::-1], inside[:, ::-1]
        ritz, mapped = basis @ inside, image @ inside
        # The Ritz vectors of the wanted pairs stay unit vectors to the last digit.
        residual = mapped - ritz * theta
        largest = max([abs(theta[0]), *map(abs, values), 1e-300])
        size_of = np.linalg.norm(residual, axis=0) / largest
        rounds += 1
        lock = 0
        for k in range(wanted - len(values)):
            place = len(values) + k
            since[place] = 0 if size_of[k] < 0.5 * best[place] else since[place] + 1
            best[place] = min(best[place], size_of[k])
            exact = size_of[k] <= EXACT or (since[place] >= STALLED and size_of[k] <= SETTLED) or len(basis.T) + len(values) == size
            lock += exact and lock == k
        if lock:
            locked = np.column_stack([locked, ritz[:, :lock] / np.linalg.norm(ritz[:, :lock], axis=0)])
            values += theta[:lock].tolist()
        if len(values) == wanted:
            return np.array(values), locked
        if rounds > 400:
            raise ArithmeticError(f"no eigenpair to double precision, residuals {size_of[:wanted]}")
        if lock or basis.shape[1] + wanted > widest:  # go on with the best vectors not locked; their products are known
            room = max(wanted + 4, widest // 2)
            basis, image = ritz[:, lock : lock + room], mapped[:, lock : lock + room]
            theta, ritz, residual = theta[lock:], ritz[:, lock:], residual[:, lock:]
        solvers = []
        for k in range(min(wanted - len(values), ritz.shape[1])):
            fixed = np.column_stack([locked, ritz[:, k]])

            def outside(v: np.ndarray, fixed: np.ndarray = fixed) -> np.ndarray:
                return v - fixed @ (fixed.T @ v)

            right = -outside(residual[:, k])
            if np.linalg.norm(right) > 0:
                solvers.append(minres(right, float(theta[k]), outside, inner))
        corrections = _side_by_side(solvers, product)
        corrections.append(rng.standard_normal(size)) if not corrections else None
        known = np.column_stack([locked, basis])
        new = _orthonormal(np.column_stack(corrections), known)
        if not new.shape[1]:
            new = _orthonormal(rng.standard_normal((size, 1)), known)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row per remaining embedding and component."""
    spark, key = embeddings.sparkSession, embeddings.schema["vec_id"].dataType.simpleString()
    schema = RESULT.format(id=key)
    x = scaled(embeddings, scale)
    fitted = fit(x)
    if fitted is None or not fitted.trace:
        return spark.createDataFrame([], schema)
    values, vectors = jacobi_davidson(fitted.product, len(fitted.sums), components)
    real = values > NO_VARIANCE * fitted.trace
    values, vectors = values[real], vectors[:, real]
    mean, n, sums = fitted.mean(), fitted.n, np.array(fitted.sums, object)
    projection, k = vectors / np.sqrt(values), len(values)

    def square(m: np.ndarray) -> np.ndarray:
        white = (m - mean) @ projection
        return white.T @ white

    covariance = np.array(_added(fitted.rows, square, "double"), float).reshape(k, k) / n
    error, explained = float(np.abs(covariance - np.eye(k)).max()), values / fitted.trace
    reach = float(max(abs(s) for s in fitted.sums))

    def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            m = _matrix(batch.column(1))
            small = n * float(np.abs(m).max()) + reach < 2**31 / math.sqrt(m.shape[1])
            gap = m.astype(np.int64 if small else object) * n - (sums.astype(np.int64) if small else sums)
            deviation = pa.array([d if d < 2**63 else None for d in (gap * gap).sum(axis=1).tolist()], pa.int64())
            number = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(number), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n)), deviation.take(number), pa.array(((m - mean) @ projection).ravel()),
                    pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
                ],
                names=[f.split()[0] for f in schema.split(", ")],
            )

    return x.select("vec_id", "x").mapInArrow(white, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
