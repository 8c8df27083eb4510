"""Embedding whitening by a bidiagonal qd solver.

Entries become whole numbers first, so counts and sums are exact. Centred rows are reduced by blockwise QR: each task folds its
rows into one triangle, block by block, and triangles are folded ``FAN`` at a time until few are left, so neither a task nor the
driver holds more than a few squares of the dimension. The triangle's squared singular values are n times the eigenvalues of the
covariance; it is never formed, so small ones keep their accuracy. They and the directions are found by ``bidiagonal``:
Householder bidiagonalisation, dqds and twisted factorisations. A last pass projects every row; one before it sums the products
of the projections, from which the largest departure from the identity follows.

Defined results: a vector that is null or empty, holds a null or a non-finite entry, or one so large that its whole number is no
long, is dropped; vectors of different dimensions are fitted apart; a component without variance has a null ``whitened`` and
explains 0; a deviation beyond a long is null; null ids and repeated rows are kept as rows of their own; an empty table gives an
empty result; other columns are left alone. Each component's sign makes the largest entry of its direction positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.bidiagonal import NOISE, right_singular
from chronoweave.llm.text import table
from chronoweave.session import cut_lineage

#: Steps a unit is cut into, and what is added to the steps.
STEPS, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Triangles that one task folds into one.
FAN = 32
LONG = 2**63 - 1


@dataclass
class Fit:
    """Of the vectors of one dimension: their number and sums, and each component's direction (columns), eigenvalue and share."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    error: float = 0.0

    def centred(self, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n x - S, exact; x - S / n) of rows of whole numbers."""
        return centred(steps, self.n, self.sums)

    def projected(self, rows: np.ndarray) -> np.ndarray:
        """Whitened components of centred rows; not a number where there is no variance."""
        scale = np.where(self.values > 0, np.sqrt(np.maximum(self.values, 0)), np.nan)
        return (rows @ self.directions) / scale


def centred(steps: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    base = [s // n for s in sums]
    low = steps - np.array(base, np.int64)
    rest = [s - n * b for s, b in zip(sums, base)]
    if len(low) and int(np.abs(low).max()) * n + n >= 2**62:
        exact = low.astype(object) * n - np.array(rest, object)
    else:
        exact = low * n - np.array(rest, np.int64)
    return exact, (exact / n).astype(np.float64)


def deviations(exact: np.ndarray) -> list[int | None]:
    """Sums of squares of each row, null beyond a long."""
    largest = max(int(exact.max(initial=0)), -int(exact.min(initial=0)))
    if largest * largest * exact.shape[1] <= LONG:
        return (exact.astype(np.int64) ** 2).sum(1).tolist()
    sums = [sum(int(v) * int(v) for v in row) for row in exact]
    return [s if s <= LONG else None for s in sums]


def blocks(batch: pa.RecordBatch):
    """(row numbers, whole numbers) for each dimension in a batch of vectors."""
    lists = batch.column("v")
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    starts = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield at, np.floor(flat[starts[at][:, None] + np.arange(dim)] * STEPS).astype(np.int64) + SHIFT


def _counted(batches):
    """Vectors to (dim, place, n, sum) of one task; sums as decimal text, for they may pass a long."""
    n, sums = {}, {}
    for batch in batches:
        for at, steps in blocks(batch):
            dim = steps.shape[1]
            total = steps.sum(0, dtype=object) if len(steps) and int(np.abs(steps).max()) * len(steps) >= 2**62 else steps.sum(0)
            n[dim] = n.get(dim, 0) + len(at)
            sums[dim] = [a + int(b) for a, b in zip(sums.get(dim, [0] * dim), total)]
    rows = [(dim, i, n[dim], str(s)) for dim in n for i, s in enumerate(sums[dim])]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, [pa.int32(), pa.int32(), pa.int64(), pa.string()])], ["dim", "place", "n", "total"])


def _folded(held: dict[int, np.ndarray], dim: int, rows: np.ndarray) -> None:
    held[dim] = np.linalg.qr(np.vstack([held[dim], rows]) if dim in held else rows, mode="r")


def _triangles(held: dict[int, np.ndarray]):
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.ascontiguousarray(r).tobytes() for r in held.values()], pa.binary())], ["dim", "triangle"])


def _reduced(of: dict[int, tuple[int, list[int]]]):
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, steps in blocks(batch):
                dim = steps.shape[1]
                _folded(held, dim, centred(steps, *of[dim])[1])
        yield from _triangles(held)

    return run


def _merged(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, triangle in zip(batch.column("dim").to_pylist(), batch.column("triangle").to_pylist()):
            _folded(held, dim, np.frombuffer(triangle, np.float64).reshape(-1, dim))
    yield from _triangles(held)


def _products(fits: dict[int, Fit]):
    """Vectors to (dim, i, j, total): sums of products of components i and j, and of component i alone where j is -1."""
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, steps in blocks(batch):
                fit = fits[steps.shape[1]]
                w = np.nan_to_num(fit.projected(fit.centred(steps)[1]))
                made = np.vstack([w.T @ w, w.sum(0)])
                sums[steps.shape[1]] = sums.get(steps.shape[1], 0) + made
        rows = [(dim, i, j, float(s[i, j])) if i < s.shape[1] else (dim, j, -1, float(s[i, j])) for dim, s in sums.items() for i in range(len(s)) for j in range(s.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, [pa.int32(), pa.int32(), pa.int32(), pa.float64()])], ["dim", "i", "j", "total"])

    return run


def _usable(vectors: DataFrame, embedding: str) -> DataFrame:
    v = F.col(embedding).cast("array<double>")
    within = F.forall(v, lambda x: F.coalesce(F.abs(x) * STEPS < float(2**62), F.lit(False)) & ~F.isnan(x))
    return vectors.withColumn("_v", v).filter(F.coalesce((F.size(v) > 0) & within, F.lit(False)))


def fit_whitening(vectors: DataFrame, embedding: str = "embedding", components: int = COMPONENTS) -> dict[int, Fit]:
    """Counts, sums and components by dimension."""
    rows = _usable(vectors, embedding).select(F.col("_v").alias("v"))
    total = F.sum(F.col("total").cast("decimal(38,0)"))
    counted = rows.mapInArrow(_counted, "dim int, place int, n bigint, total string").groupBy("dim", "place").agg(F.sum("n").alias("n"), total.alias("total"))
    of: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(counted.collect(), key=lambda r: (r["dim"], r["place"])):
        of.setdefault(r["dim"], (r["n"], []))[1].append(int(r["total"]))
    if not of:
        return {}
    kind = "dim int, triangle binary"
    triangles = cut_lineage(rows.mapInArrow(_reduced(of), kind))
    while (n := triangles.count()) > FAN * len(of):
        spread = triangles.repartition(-(-n // (FAN * len(of))))
        triangles = cut_lineage(spread.mapInArrow(_merged, kind))
    held: dict[int, np.ndarray] = {}
    for r in triangles.collect():
        _folded(held, r["dim"], np.frombuffer(r["triangle"], np.float64).reshape(-1, r["dim"]))
    fits = {}
    for dim, triangle in held.items():
        square = np.zeros((dim, dim))
        square[:len(triangle)] = triangle
        values, directions = right_singular(square)
        values = np.where(values > (max(64, dim) / 64 * NOISE) ** 2 * values[0], values, 0.0)
        k = min(components, dim)
        signs = np.sign(directions[np.abs(directions).argmax(0), np.arange(dim)])
        whole = values.sum()
        fits[dim] = Fit(*of[dim], (directions * signs)[:, :k].copy(), values[:k] / of[dim][0], values[:k] / whole if whole > 0 else np.zeros(k))
    sums = rows.mapInArrow(_products(fits), "dim int, i int, j int, total double").groupBy("dim", "i", "j").agg(F.sum("total").alias("total"))
    for dim, found in _by_dim(sums).items():
        fit = fits[dim]
        live = fit.values > 0
        mean = found[-1] / fit.n
        departure = found[:-1] / fit.n - np.outer(mean, mean) - np.eye(len(mean))
        fit.error = float(np.abs(departure[np.ix_(live, live)]).max(initial=0.0))
    return fits


def _by_dim(sums: DataFrame) -> dict[int, np.ndarray]:
    """A matrix of products, with the plain sums as its last row, by dimension."""
    out: dict[int, np.ndarray] = {}
    rows = sums.collect()
    size = {r["dim"]: 0 for r in rows}
    for r in rows:
        size[r["dim"]] = max(size[r["dim"]], r["i"] + 1)
    for r in rows:
        out.setdefault(r["dim"], np.zeros((size[r["dim"]] + 1, size[r["dim"]])))[(r["i"], r["j"]) if r["j"] >= 0 else (-1, r["i"])] = r["total"]
    return out


def whitened_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec id, n, deviation, whitened, explained, identity_error): a row per usable vector, ``whitened`` and ``explained`` being lists."""
    fits = fit_whitening(vectors, embedding, components)

    def run(batches):
        for batch in batches:
            for at, steps in blocks(batch):
                fit = fits[steps.shape[1]]
                exact, rows = fit.centred(steps)
                made = fit.projected(rows)
                k = made.shape[1]
                flat = pa.array(made.ravel(), from_pandas=True)  # not a number becomes null
                lists = lambda values: pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at)), pa.array([fit.n] * len(at), pa.int64()), pa.array(deviations(exact), pa.int64()),
                    lists(flat), lists(pa.array(np.tile(fit.explained, len(at)))), pa.array([fit.error] * len(at))],
                    ["_id", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = vectors.schema[vec_id].dataType.simpleString()
    held = _usable(vectors, embedding).select(F.col(vec_id).alias("_id"), F.col("_v").alias("v"))
    found = held.mapInArrow(run, f"_id {kind}, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double")
    return found.withColumnRenamed("_id", vec_id)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every usable vector and each of its first 32 whitened components."""
    found = whitened_vectors(table(spark, sf_dir, "embeddings"))
    each = found.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "c"))
    return each.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
