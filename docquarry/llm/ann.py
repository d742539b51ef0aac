"""Approximate nearest neighbours by inner product with randomly rotated one-bit codes.

Index: vectors are cut into about sqrt(n) / 4 cells by k-means. What a vector x differs from its cell's centroid c by,
r = x - c, is padded with zeros to ``bits`` components (a multiple of 64, 256 at least: more bits, less error) and
turned by a random orthogonal matrix of a fixed seed. Its code is the packed signs s of the turned r; correction scalars
are f = |r|^2 / <s, r> and the cosine of s and r.

Estimate: a query q is turned too and its components rounded to 16 levels, whose four bit planes meet the codes by AND
and a count of bits. <q, x> is about <q, c> + f <s, q>. The error is near normal: what s has across r meets a random direction, so
its variance is at most f^2 ((1 - cosine^2) |q|^2 + |rounding|^2). With ``errors`` (4) deviations either way there are
bounds, which fail for one vector in 30,000.

Search: the ``first`` cells of largest <q, c> give k results by exact products; the least of these is a floor. A further
cell is visited unless even its farthest member can't reach the floor (<q, c> + |q| * radius, which never fails). In a task
the best k by estimate are computed exactly and raise the floor; every vector whose upper bound reaches it is
computed exactly as well. Exact products add up the components one after the other, in double precision.

Scale: equal vectors are one entry with their k + 1 smallest ids; a query vector is searched once. A cell is dealt into blocks
of ``block`` vectors and ``block`` queries; a task sees one block of each, and k results a query leave it at most. Cells are
fitted to a sample of 16 vectors a cell (at most ``max_cells`` cells; more vectors make larger cells, dealt into more
blocks), and every vector is indexed. How many cells are visited depends on how far the vectors cluster: those without any
are visited in nearly all cells, then only the codes save work. A cluster of near copies is compared by its exact products.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows of null id, take no part.
Vectors of unequal length are compared within their length only. A query leaves out its own row and no other, rows of equal id or
vector included. Ties go to the smaller id. Fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm._shared import Scratch, slices
from docquarry.llm.vectors import SLICE, finite, kmeans, matrix, nearest, nonzero

_SEED = 20_77


def width(dim: int, bits: int) -> int:
    return 64 * -(-max(dim, bits) // 64)


@lru_cache(maxsize=4)
def rotation(dim: int, bits: int) -> np.ndarray:
    """The first ``dim`` rows of a random orthogonal matrix of ``bits`` rows."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED + bits).normal(size=(bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(r: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the rows (words of 64 bits), and their scalars f and cosine."""
    turned = r @ rotation(r.shape[1], bits)
    length, dot = np.linalg.norm(r, axis=1), np.abs(turned).sum(1)
    code = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
    some = dot > 0
    f = np.divide(length**2, dot, out=np.zeros_like(dot), where=some)
    cosine = np.divide(dot, length * np.sqrt(bits), out=np.ones_like(dot), where=some)
    return code, f, cosine


class QueryCodes:
    """Queries turned and rounded to 16 levels."""

    def __init__(self, q: np.ndarray, bits: int):
        turned = q @ rotation(q.shape[1], bits)
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / 15, np.finfo(float).tiny)
        levels = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, 15).astype(np.uint8)
        rounded = self.low[:, None] + self.step[:, None] * levels
        self.planes = [np.packbits(levels >> j & 1, axis=1, bitorder="little").view(np.uint64) for j in range(4)]
        self.total, self.length2, self.rest2 = rounded.sum(1), (q * q).sum(1), ((turned - rounded) ** 2).sum(1)

    def estimates(self, at: slice, code: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """<s, q> for queries of the slice (rows) and all codes, of which ``ones`` is the number of set bits."""
        sums = np.zeros((at.stop - at.start, len(code)), np.uint32)
        for j, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                sums += np.bitwise_count(code[:, w] & plane[at, w, None]).astype(np.uint32) << j
        return 2 * (self.low[at, None] * ones + self.step[at, None] * sums) - self.total[at, None]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner product of each row pair, component after component."""
    out = np.zeros(len(q))
    for a in range(0, len(q), SLICE):
        rows = q[a : a + SLICE].T * x[a : a + SLICE].T
        for r in rows:
            out[a : a + SLICE] += r
    return out


def _take_best(i: np.ndarray, j: np.ndarray, score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best pairs of each query i."""
    order = np.lexsort((first[j], -score, i))
    start = np.r_[True, i[order][1:] != i[order][:-1]]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return order[rank < k]


def scan(q: np.ndarray, floor: np.ndarray, x: np.ndarray, code: np.ndarray, f: np.ndarray, cosine: np.ndarray, centroid: np.ndarray, first: np.ndarray, k: int, errors: float) -> tuple:
    """``(i, j, score)``: up to k vectors j of largest exact product for each query i, of those that reach its floor."""
    bits = 64 * code.shape[1]
    codes, ones = QueryCodes(q, bits), np.bitwise_count(code).sum(1)
    worst = 1 - cosine.min() ** 2
    offset, reach = q @ centroid, errors * np.sqrt(bits / (bits - 1) * (worst * codes.length2 + codes.rest2))
    out: list[tuple] = []
    size = max(1, (1 << 20) // len(x))
    for a in range(0, len(q), size):
        at = slice(a, min(len(q), a + size))
        value = codes.estimates(at, code, ones) * f + offset[at, None]
        if len(x) > k:
            top = np.argpartition(-value, k - 1, axis=1)[:, :k]
        else:
            top = np.tile(np.arange(len(x)), (len(value), 1))
        i, j = np.repeat(np.arange(len(value)), top.shape[1]), top.ravel()
        score = products(q[at][i], x[j])
        if len(x) > k:
            least = np.maximum(floor[at], score.reshape(top.shape).min(1))
            value += reach[at, None] * f
            np.put_along_axis(value, top, -np.inf, axis=1)
            more_i, more_j = np.nonzero(value >= least[:, None])
            i, j = np.r_[i, more_i], np.r_[j, more_j]
            score = np.r_[score, products(q[at][more_i], x[more_j])]
        good = np.flatnonzero(score >= floor[at][i])
        i, j, score = i[good], j[good], score[good]
        best = _take_best(i, j, score, first, k)
        out.append((i[best] + a, j[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """``(h, g, dim, embedding, ids)``: each different sound vector with its k + 1 smallest ids; h and g are 128 bits of hash."""
    sound = vectors.where(F.col("vec_id").isNotNull() & finite("embedding") & nonzero("embedding"))
    rows = sound.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.select("vec_id", "embedding", *_hashes("embedding"))
    # the limit of a rank cuts each task's rows before they are shuffled
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    grouped = ranked.groupBy("h", "g").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return grouped.select("h", "g", F.size("embedding").alias("dim"), "embedding", "ids")


def _hashes(vector: str) -> list[Column]:
    return [F.xxhash64(vector).alias("h"), F.xxhash64(F.lit("g"), F.reverse(vector)).alias("g")]


def _fit(entries: DataFrame, max_cells: int) -> dict[int, np.ndarray]:
    """Centroids by length of vector; what reaches the driver is ``max_cells`` rows a length at most."""
    cells = F.least(F.lit(max_cells), F.greatest(F.lit(1), F.ceil(F.sqrt("count") / 4))).cast("int")
    sizes = entries.groupBy(F.col("dim").alias("of")).count().select("of", cells.alias("k"), (16 * cells / F.col("count")).alias("share"))
    drawn = entries.join(sizes, F.col("dim") == F.col("of")).where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < F.col("share"))

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("h", "ascending"), ("g", "ascending")])
        x = matrix(rows["embedding"])
        c = kmeans(x, min(rows["k"][0].as_py(), len(x)))
        return pa.table({"dim": rows["dim"].take([0]), "c": pa.array([c.tobytes()], pa.binary())})

    got = drawn.select("h", "g", "dim", "embedding", "k").groupBy("dim").applyInArrow(fit, "dim int, c binary").collect()
    return {r.dim: np.frombuffer(r.c).reshape(-1, r.dim) for r in got}


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


INDEX = "h long, g long, ids array<long>, dim int, cell int, apart double, f double, cosine double, code binary, embedding array<double>"


def index(entries: DataFrame, centroids: dict[int, np.ndarray], bits: int) -> DataFrame:
    """Every vector with its cell, code and scalars; ``apart`` is its distance from the centroid."""
    shared = entries.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            for dim, rows in _by_dim(batch):
                x, c = matrix(rows.column("embedding")), shared.value.get(dim, np.zeros((1, dim)))
                cell = nearest(x, c)
                r = x - c[cell]
                code, f, cosine = encode(r, width(dim, bits))
                arrays = {n: rows.column(n) for n in ("h", "g", "ids", "dim")}
                arrays |= {"cell": cell.astype(np.int32), "apart": np.linalg.norm(r, axis=1), "f": f, "cosine": cosine}
                yield pa.RecordBatch.from_pydict(arrays | {"code": pa.array([w.tobytes() for w in code], pa.binary()), "embedding": rows.column("embedding")})

    return entries.mapInArrow(run, INDEX)


def _visits(queries: DataFrame, centroids: dict, radius: dict, first: int, again: bool) -> DataFrame:
    """``queries(qh, qg, dim, embedding, floor)`` once for each cell to visit: the first ones, or again all others that may reach the floor."""
    shared = queries.sparkSession.sparkContext.broadcast((centroids, radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            for dim, rows in _by_dim(batch):
                q, c = matrix(rows.column("embedding")), shared.value[0].get(dim, np.zeros((1, dim)))
                near = q @ c.T
                k = min(first, len(c))
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                if again:
                    farthest = near + np.linalg.norm(q, axis=1)[:, None] * shared.value[1][dim]
                    floor = rows.column("floor").to_numpy(zero_copy_only=False)[:, None]
                    wanted = farthest >= floor - 1e-9 * np.abs(floor)  # rounding must not lose a cell
                    np.put_along_axis(wanted, top, False, axis=1)
                    i, cell = np.nonzero(wanted)
                else:
                    i, cell = np.repeat(np.arange(len(q)), k), top.ravel()
                for a in range(0, len(i), SLICE):
                    part = rows.take(pa.array(i[a : a + SLICE]))
                    yield part.append_column("cell", pa.array(cell[a : a + SLICE], pa.int32()))

    return queries.mapInArrow(run, T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType())]))


def _search(visits: DataFrame, indexed: DataFrame, sizes: DataFrame, centroids: dict, k: int, bits: int, errors: float, block: int) -> DataFrame:
    """``(qh, qg, h, g, score, ids)``: the best of each visited cell, block by block."""
    n = visits.groupBy(F.col("dim").alias("v_dim"), F.col("cell").alias("v_cell")).agg(F.ceil(F.count("*") / block).cast("int").alias("q_blocks"))
    dealt = sizes.join(n, (F.col("of_dim") == F.col("v_dim")) & (F.col("of_cell") == F.col("v_cell"))).select(
        "of_dim", "of_cell", "q_blocks", F.ceil(F.col("n") / block).cast("int").alias("x_blocks")
    )
    cell = (F.col("dim") == F.col("of_dim")) & (F.col("cell") == F.col("of_cell"))
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    of = lambda c, n: F.pmod(F.col(c), F.col(n)).cast("int")
    left = visits.join(dealt, cell).withColumn("bq", of("qh", "q_blocks")).withColumn("bx", all_of("x_blocks"))
    left = left.select("dim", "cell", "bq", "bx", "qh", "qg", "floor", F.col("embedding").alias("q"))
    right = indexed.join(dealt, cell).withColumn("bx", of("h", "x_blocks")).withColumn("bq", all_of("q_blocks"))
    right = right.select("dim", "cell", "bq", "bx", "h", "g", "ids", "f", "cosine", "code", "embedding")
    shared = visits.sparkSession.sparkContext.broadcast(centroids)

    def run(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        if not (asked.num_rows and held.num_rows):
            return pa.table({"qh": pa.array([], pa.int64()), "qg": pa.array([], pa.int64()), "h": pa.array([], pa.int64()), "g": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        dim, c = key[0].as_py(), key[1].as_py()
        centroid = shared.value[dim][c] if dim in shared.value else np.zeros(dim)
        code = np.frombuffer(b"".join(held["code"].to_pylist()), np.uint64).reshape(held.num_rows, -1)
        ids = held["ids"].combine_chunks()
        first = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
        scalars = [held[c].to_numpy() for c in ("f", "cosine")]
        i, j, score = scan(matrix(asked["q"]), asked["floor"].to_numpy(), matrix(held["embedding"]), code, *scalars, centroid, first, k, errors)
        mine, theirs = asked.select(["qh", "qg"]).take(pa.array(i)), held.select(["h", "g", "ids"]).take(pa.array(j))
        return pa.table({"qh": mine["qh"], "qg": mine["qg"], "h": theirs["h"], "g": theirs["g"], "score": score, "ids": theirs["ids"]})

    keys = ("dim", "cell", "bq", "bx")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "qh long, qg long, h long, g long, score double, ids array<long>")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qh", "qg").orderBy(F.desc("score"), F.col("ids")[0])
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, bits: int = 256, max_cells: int = 4096, first: int = 4, errors: float = 4.0, block: int = 8192
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``vectors(vec_id, embedding)`` that is a query, its k nearest other rows."""
    scratch = Scratch(vectors.sparkSession, "ann")
    entries = scratch.keep(distinct_vectors(vectors, k), "entries")
    centroids = _fit(entries, max_cells)
    indexed = scratch.keep(index(entries, centroids, bits), "index")
    sizes = scratch.keep(indexed.groupBy(F.col("dim").alias("of_dim"), F.col("cell").alias("of_cell")).agg(F.count("*").alias("n"), F.max("apart").alias("radius")), "sizes")
    radius = {d: np.full(len(c), -np.inf) for d, c in centroids.items()}
    for r in sizes.collect():  # a row a cell
        radius.setdefault(r.of_dim, np.full(1, -np.inf))[r.of_cell] = r.radius
    sound = vectors.where(F.col("vec_id").isNotNull() & finite("embedding") & nonzero("embedding") & is_query)
    asking = sound.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).select(F.col("vec_id").alias("query_id"), *_hashes("embedding"))
    asking = scratch.keep(asking, "asking")
    asked = asking.select(F.col("h").alias("qh"), F.col("g").alias("qg")).distinct()
    asked = entries.join(asked, (F.col("h") == F.col("qh")) & (F.col("g") == F.col("qg"))).select("qh", "qg", "dim", "embedding")
    rest = (k + 1, bits, errors, block)
    begin = scratch.keep(_visits(asked.withColumn("floor", F.lit(float("-inf"))), centroids, radius, first, False), "visits-1")
    near = scratch.keep(_best(_search(begin, indexed, sizes, centroids, *rest), k + 1), "found-1")
    # with fewer than k + 1 found there is no floor yet
    floors = near.groupBy(F.col("qh").alias("of_h"), F.col("qg").alias("of_g")).agg(F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("floor"))
    floored = asked.join(floors, (F.col("qh") == F.col("of_h")) & (F.col("qg") == F.col("of_g"))).drop("of_h", "of_g")
    visits = scratch.keep(_visits(floored, centroids, radius, first, True), "visits-2")
    found = _best(near.unionByName(_search(visits, indexed, sizes, centroids, *rest)), k + 1)
    one = F.struct((-F.col("score")).alias("minus"), F.col("ids"), ((F.col("h") == F.col("qh")) & (F.col("g") == F.col("qg"))).alias("same"))
    lists = found.groupBy("qh", "qg").agg(F.collect_list(one).alias("found"))  # k + 1 at most
    rows = F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct(x["minus"].alias("minus"), i.alias("vec_id"), x["same"].alias("same")))))
    lists = scratch.keep(lists.select("qh", "qg", F.slice(F.array_sort(rows), 1, k + 1).alias("found")), "lists")
    scratch.leave("asking", "lists")
    own = F.array_position(F.transform("found", lambda x: x["same"] & (x["vec_id"] == F.col("query_id"))), True).cast("int")
    others = F.slice(F.filter("found", lambda x, i: (F.col("own") == 0) | (i != F.col("own") - 1)), 1, k)
    answers = asking.join(lists, (F.col("h") == F.col("qh")) & (F.col("g") == F.col("qg"))).withColumn("own", own).select("query_id", F.posexplode(others).alias("pos", "x"))
    return answers.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
