"""Search indexes: product-quantised inverted lists, page candidates from token centroids, and an n-gram index of substrings.

Each is a table that Spark makes and joins; what is fitted (centroids, codebooks) is fitted to a bounded sample and
has a size that its parameters bound. Rankings end with a unique key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.operators.retrieval import best_of, matrix, top_k
from docquarry.sources.scratch import keep

#: Rows whose products are formed at a time; numbers held for a few queries and the codes of a block.
_SLICE, _HELD = 1024, 500_000


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(x: np.ndarray, c: np.ndarray, n: int = 1, product: bool = False) -> np.ndarray:
    """The n nearest centroids of each row, by distance or by largest product; a slice of rows at a time."""
    half = 0.0 if product else (c * c).sum(1) / 2
    n = min(n, len(c))
    out = [np.zeros((0, n), np.int64)]
    for a in range(0, len(x), _SLICE):
        near = half - x[a : a + _SLICE] @ c.T
        out.append(np.argpartition(near, n - 1, axis=1)[:, :n].copy() if n < len(c) else np.tile(np.arange(n), (len(near), 1)))
    return np.concatenate(out)


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids from evenly spread rows."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        home = _nearest(x, c)[:, 0]
        order = np.argsort(home, kind="stable")
        there, starts, size = np.unique(home[order], return_index=True, return_counts=True)
        c[there] = np.add.reduceat(x[order], starts, axis=0) / size[:, None]
    return c


def _sample(rows: DataFrame, key: str, vector: str, most: int) -> np.ndarray:
    """About ``most`` vectors, drawn by a hash of the key."""
    share = min(1.0, most / max(1, rows.count()))
    drawn = rows.where(F.shiftrightunsigned(F.xxhash64(key), 11) / F.lit(float(1 << 53)) < share).orderBy(key).select(F.col(vector).alias("v")).toArrow()["v"]
    return _rows(drawn) if len(drawn) else np.zeros((0, 1))


@dataclass
class Quantiser:
    """Coarse centroids, and a codebook of at most 256 entries for each part of what a vector differs from its centroid by."""

    centroids: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, parts: int) -> Quantiser:
        c = kmeans(x, cells)
        rest = x - c[_nearest(x, c)[:, 0]]
        return cls(c, [kmeans(r, 256) for r in np.array_split(rest, parts, axis=1)])

    def encode(self, rest: np.ndarray) -> np.ndarray:
        cut = np.array_split(rest, len(self.books), axis=1)
        return np.stack([_nearest(r, b)[:, 0] for r, b in zip(cut, self.books, strict=True)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each query's parts with all entries of their codebooks: (queries, parts, 256)."""
        out = np.zeros((len(q), len(self.books), 256))
        for i, (part, book) in enumerate(zip(np.array_split(q, len(self.books), axis=1), self.books, strict=True)):
            out[:, i, : len(book)] = part @ book.T
        return out


def pq_index(pages: DataFrame, quantiser: Quantiser) -> DataFrame:
    """``(cell, page_id, code)`` of ``pages(page_id, vec)``: the inverted lists, one byte a part, in a table partitioned by cell."""
    shared = pages.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, _SLICE) for b in batches for a in range(0, b.num_rows, _SLICE)):
            x, q = _rows(batch.column(1)), shared.value
            cell = _nearest(x, q.centroids)[:, 0]
            code = q.encode(x - q.centroids[cell])
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in code], pa.binary())], names=["cell", "page_id", "code"])

    coded = pages.select("page_id", "vec").mapInArrow(run, T.StructType([T.StructField("cell", T.IntegerType()), pages.schema["page_id"], T.StructField("code", T.BinaryType())]))
    return keep(coded.hint("rebalance", "cell"), "pq-index", "cell")


def guesses(q: np.ndarray, base: np.ndarray, code: np.ndarray, quantiser: Quantiser, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, code, guess)``: the ``most`` codes of largest product of each query; what is held besides is a few MB, whatever their numbers."""
    out, n = [], min(most, len(code))
    step = max(1, min(64, _HELD // len(code)))
    for a in range(0, len(q), step):
        table = quantiser.tables(q[a : a + step])
        guess = np.repeat(base[a : a + step, None], len(code), axis=1)
        for s in range(code.shape[1]):
            guess += table[:, s][:, code[:, s]]
        top = np.argpartition(-guess, n - 1, axis=1)[:, :n] if n < len(code) else np.tile(np.arange(n), (len(guess), 1))
        out.append((np.repeat(np.arange(a, a + len(guess)), n), top.ravel(), np.take_along_axis(guess, top, 1).ravel()))
    i, j, guess = (np.concatenate(c) for c in zip(*out, strict=True))
    return i, j, guess


def pq_search(queries: DataFrame, index: DataFrame, pages: DataFrame, quantiser: Quantiser, k: int, probes: int, rerank: int = 100, block: int = 16_384) -> DataFrame:
    """``(query_id, page_id, score, rank)``: codes of the ``probes`` cells of largest product rank the pages by tables of products; the
    best ``rerank`` of a query are ranked by exact products of ``pages(page_id, vec)``.

    A cell of more than ``block`` codes is dealt into blocks; a task holds one block and a block of queries. From a block leave the
    ``rerank`` best of a query, so vectors move only for those. Only partitions of probed cells are read.
    """
    shared = queries.sparkSession.sparkContext.broadcast(quantiser)
    asked = queries.select("query_id", F.col("vec").alias("q"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _nearest(_rows(batch.column(1)), shared.value.centroids, probes, product=True)
            yield batch.append_column("cells", pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())))

    visits = asked.mapInArrow(cells, T.StructType([*asked.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))
    visits = keep(visits.select("query_id", "q", F.explode("cells").alias("cell")), "pq-visits")
    x_shape = index.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("nx"))
    shape = visits.groupBy("cell").agg(F.ceil(F.count("*") / 2048).cast("int").alias("nq")).join(x_shape, "cell")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(shape, "cell").select("cell", F.pmod(F.xxhash64("query_id"), "nq").cast("int").alias("bq"), all_of("nx").alias("bx"), "query_id", "q")
    right = index.join(shape, "cell").select("cell", F.pmod(F.xxhash64("page_id"), "nx").cast("int").alias("bx"), all_of("nq").alias("bq"), "page_id", "code")

    def run(key: tuple, some: pa.Table, held: pa.Table) -> pa.Table:
        if not (some.num_rows and held.num_rows):
            return pa.table([some["query_id"].slice(0, 0), held["page_id"].slice(0, 0), pa.array([], pa.float64())], names=["query_id", "page_id", "guess"])
        held = held.sort_by("page_id")
        q, quant = _rows(some["q"]), shared.value
        code = np.frombuffer(b"".join(held["code"].to_pylist()), np.uint8).reshape(held.num_rows, -1)
        i, j, guess = guesses(q, q @ quant.centroids[key[0].as_py()], code, quant, rerank)
        return pa.table([some["query_id"].take(pa.array(i)), held["page_id"].take(pa.array(j)), pa.array(guess)], names=["query_id", "page_id", "guess"])

    kinds = T.StructType([queries.schema["query_id"], pages.schema["page_id"], T.StructField("guess", T.DoubleType())])
    found = left.groupBy("cell", "bq", "bx").cogroup(right.groupBy("cell", "bq", "bx")).applyInArrow(run, kinds)
    best = top_k(found, ["query_id"], [F.col("guess").desc(), F.col("page_id").asc()], rerank).select("query_id", "page_id")
    both = best.join(pages.select("page_id", "vec"), "page_id").join(asked, "query_id")
    exact = F.aggregate(F.zip_with("q", "vec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = both.select("query_id", "page_id", exact.alias("score"))
    return top_k(scored, ["query_id"], [F.round("score", 9).desc(), F.col("page_id").asc()], k)


def fit_quantiser(pages: DataFrame, cells: int, parts: int, sample: int = 20_000) -> Quantiser:
    """A quantiser of ``pages(page_id, vec)``, fitted to about ``sample`` of them; vectors of one length."""
    x = _sample(pages, "page_id", "vec", sample)
    return Quantiser.fit(x if len(x) else np.zeros((1, 1)), cells, parts if len(x) else 1)


def pruned_maxsim(queries: DataFrame, pages: DataFrame, k: int, cells: int, probes: int, candidates: int, sample: int = 20_000, block: int = 16_384) -> DataFrame:
    """``(query_id, page_id, score, rank)``: late interaction over candidate pages only.

    ``queries(query_id, vecs)`` and ``pages(page_id, vecs)`` hold arrays of vectors. Every token of a page is known by its nearest
    centroid. A query's token asks the ``probes`` centroids of largest product for pages, each page counts with the largest product
    of the centroids it has, and the ``candidates`` pages of largest sum are scored with all their tokens.

    Queries and pages are dealt by a hash into blocks of about ``block`` tokens. A task holds the products of a block of queries with the centroids and
    the centroids of a block of pages, looks up sums some queries at a time, and the ``candidates`` best pages of each query leave: no row
    is made for a query's token and a page, a common centroid is no hot key, and vectors move for candidates only.
    """
    tokens = lambda rows, key: rows.select(key, F.posexplode("vecs").alias("pos", "vec"))
    x = _sample(tokens(pages, "page_id").withColumn("of", F.struct("page_id", "pos")), "of", "vec", sample)
    shared = queries.sparkSession.sparkContext.broadcast(kmeans(x, cells) if len(x) else np.zeros((1, 1)))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's products with its tokens' ``probes`` best centroids, minus infinity for the others: tokens by centroids."""
        for batch in (b.slice(a, 500) for b in batches for a in range(0, b.num_rows, 500)):
            (v, n), c = matrix(batch.column(1), False), shared.value
            asks = np.full((len(v), len(c)), -np.inf)
            near = _nearest(v, c, max(2, probes), product=True)
            for a in range(0, len(v), _SLICE):
                np.put_along_axis(asks[a : a + _SLICE], near[a : a + _SLICE], np.take_along_axis(v[a : a + _SLICE] @ c.T, near[a : a + _SLICE], 1), 1)
            flat = pa.array(asks.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n * len(c))).astype(np.int32)), flat)], names=["query_id", "asks"])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, n = matrix(batch.column(1), False)
            cell = pa.array(_nearest(v, shared.value)[:, 0].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), cell)], names=["page_id", "cells"])

    some = lambda rows: rows.where(F.size("vecs") > 0)
    asked = some(queries.select("query_id", "vecs")).mapInArrow(products, T.StructType([queries.schema["query_id"], T.StructField("asks", T.ArrayType(T.DoubleType()))]))
    held = some(pages.select("page_id", "vecs")).mapInArrow(homes, T.StructType([pages.schema["page_id"], T.StructField("cells", T.ArrayType(T.IntegerType()))]))
    asked, held = keep(asked, "maxsim-asks"), keep(held, "maxsim-cells")
    blocks = lambda rows, of, size, name: rows.agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size(of)) / size)).cast("int").alias(name))
    shape = blocks(asked, "asks", block * len(shared.value), "nq").crossJoin(blocks(held, "cells", block, "np")).first() or (1, 1)
    nq, np_ = (n or 1 for n in shape)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("qb"), all_of(np_).alias("pb"), "query_id", "asks")
    right = held.select(all_of(nq).alias("qb"), F.pmod(F.xxhash64("page_id"), F.lit(np_)).cast("int").alias("pb"), "page_id", "cells")

    def guess(some: pa.Table, there: pa.Table) -> pa.Table:
        there = there.sort_by("page_id")
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if some.num_rows and there.num_rows:
            width, asks, cell = len(shared.value), some["asks"].combine_chunks(), there["cells"].combine_chunks()
            n = pa.compute.list_value_length(asks).to_numpy() // width
            sums, starts = asks.flatten().to_numpy().reshape(-1, width), np.cumsum(n) - n
            sizes, flat = pa.compute.list_value_length(cell).to_numpy(), cell.flatten().to_numpy()
            firsts = np.cumsum(sizes) - sizes
            step = max(1, 1_000_000 * len(n) // (len(sums) * len(flat)))
            for a in range(0, len(n), step):
                b = min(len(n), a + step)
                best = np.maximum.reduceat(sums[starts[a] : starts[b - 1] + n[b - 1]][:, flat], firsts, axis=1)
                met = best > -np.inf
                best[~met] = 0
                total = np.add.reduceat(best, starts[a:b] - starts[a], axis=0)
                total[~np.logical_or.reduceat(met, starts[a:b] - starts[a], axis=0)] = -np.inf
                row, col = best_of(total, candidates)
                out.append((a + row, col, total[row, col]))
        row, col, total = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([some["query_id"].take(pa.array(row)), there["page_id"].take(pa.array(col)), pa.array(total)], names=["query_id", "page_id", "guess"])

    kinds = T.StructType([queries.schema["query_id"], pages.schema["page_id"], T.StructField("guess", T.DoubleType())])
    guessed = left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInArrow(guess, kinds)
    best = top_k(guessed, ["query_id"], [F.round("guess", 9).desc(), F.col("page_id").asc()], candidates).select("query_id", "page_id")
    both = best.join(pages.select("page_id", "vecs"), "page_id").join(queries.select("query_id", F.col("vecs").alias("asked")), "query_id").select("query_id", "page_id", "asked", "vecs")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, 1000) for b in batches for a in range(0, b.num_rows, 1000)):
            (q, n_q), (p, n_p) = matrix(batch.column(2), False), matrix(batch.column(3), False)
            to_q, to_p = np.cumsum(n_q), np.cumsum(n_p)
            got = [float((q[a - i : a] @ p[b - j : b].T).max(1).sum()) for a, i, b, j in zip(to_q, n_q, to_p, n_p, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64())], names=["query_id", "page_id", "score"])

    scored = both.mapInArrow(score, T.StructType([queries.schema["query_id"], pages.schema["page_id"], T.StructField("score", T.DoubleType())]))
    return top_k(scored, ["query_id"], [F.round("score", 9).desc(), F.col("page_id").asc()], k)


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters, in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


#: An odd factor that spreads codes of runs over a table of 2 ** _BITS marks.
_SPREAD, _BITS = 0x9E3779B97F4A7C15, 20


def _gram_code(gram: Column) -> Column:
    """A run of one to three characters as a number, 21 bits a character."""
    place = lambda i: F.when(F.length(gram) > i, F.ascii(F.substring(gram, i + 1, 1)).cast("long") + 1).otherwise(F.lit(0).cast("long"))
    return F.shiftleft(place(0), 42).bitwiseOR(F.shiftleft(place(1), 21)).bitwiseOR(place(2))


def _slots(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (codes.astype(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(64 - _BITS)


def _held_grams(docs: DataFrame, corpus: str, key: str, wanted: DataFrame) -> DataFrame:
    """``(corpus, key, gram)``: the distinct runs of each text whose mark is set; a mark may be that of another run of ``wanted(run)``.

    The marks have one size whatever is wanted, and come from a distinct aggregation over the runs.
    """

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(batch.column(0).to_numpy())).astype(np.int32))], names=["slot"])

    marks = np.zeros(1 << _BITS, bool)
    marks[wanted.select("run").distinct().mapInArrow(marked, "slot int").distinct().toArrow()["slot"].to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_wanted = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part, found = batch.slice(a, 500), []
                for text in part.column(2).to_pylist():
                    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
                    one, two = c << 42, (c[:-1] << 42) | (c[1:] << 21)
                    codes = np.concatenate([one, two, two[:-1] | c[2:]])
                    found.append(np.unique(codes[is_wanted[_slots(codes)]]))
                of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(np.concatenate(found))], names=[corpus, key, "gram"])

    return docs.select(corpus, key, "h").mapInArrow(run, T.StructType([docs.schema[corpus], docs.schema[key], T.StructField("gram", T.LongType())]))


def substring_counts(docs: DataFrame, terms: DataFrame, key: str, corpus: str = "corpus") -> DataFrame:
    """``(corpus, key, term, n)``: how often each term occurs in the texts of its corpus, for those where it does.

    ``docs(corpus, key, h)``, ``terms(corpus, term)``; terms aren't empty. An index of n-grams finds the texts: of the three-character
    runs of a term (a shorter term is its own run) the one that fewest texts of the corpus have fetches them by an equi-join,
    and the texts themselves decide. Only runs that terms have are indexed; a task finds them by their codes, without making all runs of a text rows.
    """
    asked = terms.where("term <> ''").select(corpus, "term").distinct()
    parts = asked.withColumn("gram", F.explode(F.when(F.length("term") >= 3, _grams(F.col("term"), 3)).otherwise(F.array("term"))))
    parts = keep(parts.withColumn("gram", _gram_code(F.col("gram"))), "grams")
    wanted = parts.select(F.col(corpus).alias("in"), F.col("gram").alias("run")).distinct()
    posted = _held_grams(docs, corpus, key, wanted).join(wanted, (F.col(corpus) == F.col("in")) & (F.col("gram") == F.col("run")), "left_semi")
    posted = keep(posted, "postings")
    sizes = posted.groupBy(corpus, "gram").agg(F.count("*").alias("size"))
    # a run that no text has tells that the term is nowhere
    rarest = parts.join(sizes, [corpus, "gram"], "left").groupBy(corpus, "term").agg(F.min_by("gram", F.struct(F.coalesce("size", F.lit(0)).alias("size"), "gram")).alias("gram"))
    fetched = posted.join(rarest, [corpus, "gram"]).groupBy(corpus, key).agg(F.collect_set("term").alias("terms"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(a, 200) for b in batches for a in range(0, b.num_rows, 200)):
            found = [[(t, n) for t in terms if (n := h.count(t))] for h, terms in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            flat = [x for f in found for x in f]
            yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array([t for t, _ in flat], pa.string()), pa.array([n for _, n in flat], pa.int64())], names=[corpus, key, "term", "n"])

    both = docs.select(corpus, key, "h").join(fetched, [corpus, key]).select(corpus, key, "h", "terms")
    return both.mapInArrow(count, T.StructType([docs.schema[corpus], docs.schema[key], T.StructField("term", T.StringType()), T.StructField("n", T.LongType())]))
