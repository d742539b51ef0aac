"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Entries become whole numbers first (``floor(scale * c) + shift``), so counts, sums and each row's deviation are exact, and a row is
centred with one rounding: x minus the whole part of the mean, minus its fraction.

Bidiagonalisation: with X the centred rows, step k forms the product X v, takes from it what it has along the left vectors
u of all earlier steps (twice), and its length is alpha; the product X'u, freed of all earlier right vectors v (twice), has the
length beta and gives the next v. Left vectors have one entry a row, so they are never stored: each is X times a
short vector g, and a task forms the entries of its rows from it. The small bidiagonal matrix of alphas and betas holds
the singular values; its SVD gives components and deviations. Steps go on until the residuals of the wanted ones vanish, at most
one step a dimension. Where a product vanishes (repeated or zero variances), a new direction goes on and all dimensions
are gone through, so that equal variances all are found.

Scale: rows are packed once into blocks of about a million numbers, in a table; each step is two passes over it. A task holds one
block at a time and gives one short vector, which are summed by place; the driver holds short vectors only (dimensions
by steps). Nothing depends on ids, so no key can be hot.

Edge cases: rows whose vector is null or holds null or non-finite entries are dropped; an empty vector has no component. Vectors of
each length are a fit of their own. Rows of equal or null id are rows like any other. Components of no variance
(a deviation below 1e-9 of the largest) are left out, so equal rows, or one row, give none. ``deviation`` is null where it doesn't
fit in 63 bits. An empty table gives an empty result. Extra columns are of no account.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm._shared import Scratch, slices
from docquarry.llm.vectors import finite

#: Numbers in a block.
BLOCK = 1 << 20
#: Residuals, relative to the largest singular value, at which components are done; and the least deviation of a component.
DONE, LEAST = 2e-15, 1e-9


@dataclass
class Fit:
    """What is known of the rows of one length. ``base + rest`` is the mean, whole part and fraction."""

    n: int
    sums: list[int]
    components: np.ndarray | None = None
    variances: np.ndarray | None = None
    trace: float = 0.0
    error: float = 0.0

    def __post_init__(self):
        self.base = np.array([s // self.n for s in self.sums], np.int64)
        self.left = np.array([s % self.n for s in self.sums], np.int64)
        self.rest = self.left / self.n

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Exact sums of (n * x - S)^2."""
        y = x - self.base
        fits = ((y - self.rest) ** 2).sum(1) * float(self.n) ** 2 < 2.0**63 * (1 - 1e-9)
        exact = self.n * np.where(fits[:, None], y, 0) - self.left
        return pa.array((np.where(fits[:, None], exact, 0) ** 2).sum(1), pa.int64(), mask=~fits)


def fixed_point(vectors: DataFrame, scale: int, shift: int) -> DataFrame:
    """``(vec_id, dim, x)``: the remaining vectors in whole numbers."""
    whole = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift).cast("long"))
    return vectors.where(finite("embedding")).select("vec_id", F.size("embedding").alias("dim"), whole.alias("x"))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(rows: DataFrame, dim: int) -> DataFrame:
    size = max(1, BLOCK // dim)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(held)
        small = np.abs(x).max() < 1 << 31
        return pa.RecordBatch.from_pydict({"n": pa.array([len(x)], pa.int32()), "x": pa.array([x.astype(np.int32 if small else np.int64).tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in slices(batches, size):
            held.append(_numbers(batch.column(0)))
            if sum(map(len, held)) >= size:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    return rows.where(F.col("dim") == dim).select("x").mapInArrow(run, "n int, x binary")


def _summed(blocks: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[int, list]:
    """Sums over all blocks of what ``part`` gives for one, a vector (or two, as rows): {place: values}."""
    names = ["a"] if kind == "double" else ["a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(data, np.int32 if len(data) == 4 * n * dim else np.int64).reshape(n, dim)
                more = np.atleast_2d(part(x))
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1], dtype=np.int32)), *map(pa.array, total)], names=["place", *names])

    got = blocks.mapInArrow(run, ", ".join(["place int", *(f"{n} {kind}" for n in names)])).groupBy("place").agg(*[F.sum(F.col(n).cast("double" if kind == "double" else "decimal(38,0)")).alias(n) for n in names])
    return {r[0]: list(r[1:]) for r in got.collect()}


def _exact_sums(blocks: DataFrame, dim: int) -> list[int]:
    """Column sums, from high and low halves so that no sum of a task overflows."""

    def halves(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64, copy=False)
        return np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])

    got = _summed(blocks, dim, halves, "long")
    return [(int(got[i][0]) << 32) + int(got[i][1]) for i in range(dim)]


def _vector(blocks: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    got = _summed(blocks, dim, part, "double")
    return np.array([got[i][0] for i in range(len(got))])


def _freed(r: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """What of r is across all of the basis, twice taken."""
    if basis:
        v = np.array(basis)
        for _ in range(2):
            r = r - v.T @ (v @ r)
    return r


def bidiagonalise(blocks: DataFrame, dim: int, fit: Fit, wanted: int) -> None:
    """Puts the leading components and variances into ``fit``."""
    rng = np.random.default_rng(dim)
    fresh = lambda basis: (lambda r: r / np.linalg.norm(r))(_freed(rng.normal(size=dim), basis))
    vs: list[np.ndarray] = []
    alphas: list[float] = []
    betas: list[float] = []
    g, ps = np.zeros((dim, 0)), np.zeros((dim, 0))
    centred = fit.centred
    v, broken, norm = fresh(vs), False, 0.0
    while True:
        vs.append(v)

        def along(x: np.ndarray, g: np.ndarray = g, v: np.ndarray = v) -> np.ndarray:
            x = centred(x)
            w = x @ v
            return np.r_[(x @ g).T @ w, w @ w, (x * x).sum()]

        *c, square, total = _vector(blocks, dim, along)
        fit.trace = total / fit.n
        norm = np.sqrt(total)
        if norm == 0:
            break
        c = np.array(c)
        new = v - g @ c

        def back(x: np.ndarray, g: np.ndarray = g, new: np.ndarray = new) -> np.ndarray:
            x = centred(x)
            u = x @ new
            return np.r_[(x @ g).T @ u, u @ u, x.T @ u]

        got = _vector(blocks, dim, back)
        again, square, p = got[: len(c)], got[len(c)], got[len(c) + 1 :]
        # the second time little is left along earlier vectors; X'u and the length follow it
        new, p, square = new - g @ again, p - ps @ again, square - again @ again
        if betas:
            betas[-1] = float(c[-1] + again[-1]) if betas[-1] else 0.0
        alpha = float(np.sqrt(max(square, 0.0)))
        if alpha <= 1e-14 * norm:
            alpha, new, p, broken = 0.0, np.zeros(dim), np.zeros(dim), True
        else:
            new, p = new / alpha, p / alpha
        alphas.append(alpha)
        g, ps = np.c_[g, new], np.c_[ps, p]
        r = _freed(p - alpha * v, vs)
        beta = float(np.linalg.norm(r))
        small = np.diag(alphas) + np.diag(betas, 1)
        left, sigma, right = np.linalg.svd(small)
        if len(vs) == dim:
            break
        if beta <= 1e-14 * norm:
            beta, broken = 0.0, True
        elif not broken and len(vs) >= wanted and (beta * np.abs(left[-1, :wanted]) <= DONE * sigma[0]).all():
            break
        betas.append(beta)
        v = r / beta if beta else fresh(vs)
    if norm == 0:
        return
    keep = min(wanted, int((sigma > LEAST * sigma[0]).sum()))
    components = np.array(vs).T @ right[:keep].T
    fit.components, fit.variances = components / np.linalg.norm(components, axis=0), sigma[:keep] ** 2 / fit.n


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Per remaining row of ``vectors(vec_id, embedding)`` and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = scratch.keep(fixed_point(vectors, scale, shift), "rows")
    fits: dict[int, Fit] = {}
    for dim, n in sorted(tuple(r) for r in rows.where("dim > 0").groupBy("dim").count().collect()):
        blocks = scratch.keep(_blocks(rows, dim), f"blocks-{dim}")
        fit = Fit(n, _exact_sums(blocks, dim))
        bidiagonalise(blocks, dim, fit, components)
        if fit.components is not None:
            to = fit.components / np.sqrt(fit.variances)

            def covariance(x: np.ndarray, to: np.ndarray = to, centred: Callable = fit.centred) -> np.ndarray:
                y = centred(x) @ to
                return (y.T @ y).ravel()

            k = to.shape[1]
            fit.error = float(np.abs(_vector(blocks, dim, covariance).reshape(k, k) / n - np.eye(k)).max())
            fits[dim] = fit
        scratch.drop(f"blocks-{dim}")
    shared = vectors.sparkSession.sparkContext.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if (fit := shared.value.get(dim)) is None:
                    continue
                some = batch.filter(pa.array(dims == dim))
                x, k = _numbers(some.column("x")), len(fit.variances)
                y = (fit.centred(x) @ fit.components) / np.sqrt(fit.variances)
                at, m = pa.array(np.repeat(np.arange(len(x)), k)), len(x) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, fit.n)), fit.deviations(x).take(at),
                        pa.array(y.ravel()), pa.array(np.tile(fit.variances / fit.trace, len(x))), pa.array(np.full(m, fit.error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    rest = T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double").fields
    return rows.mapInArrow(run, T.StructType([rows.schema["vec_id"], *rest]))
