"""Ranking: BM25, dense and multi-vector search, phrase and keyword ranks, packing.

Scores are joined on terms, or made by products of a block of queries and a block of rows, from which the best rows leave.
All rankings end with a unique key, so results don't depend on the order of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.sources.scratch import keep


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, ranked from 1. Spark cuts each map task's rows to k per group first."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def term_counts(chunks: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """``(*keys, term, tf)`` of token arrays."""
    return chunks.select(*keys, F.explode(tokens).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def counted_terms(questions: DataFrame, chunks: DataFrame, extra: list[str]) -> DataFrame:
    """``(corpus, chunk_id, *extra, size, term, tf)`` of the asked terms of each chunk, and a row of term "" for every chunk.

    Written once, so that texts are cut into tokens once: sizes, counts of documents and weights all come from it.
    """
    vocabulary = questions.select("corpus", F.explode(F.array_append(F.array_distinct("tokens"), F.lit(""))).alias("term")).distinct()
    words = chunks.select("corpus", "chunk_id", *extra, F.size("tokens").alias("size"), F.explode(F.array_append("tokens", F.lit(""))).alias("term"))
    held = words.join(vocabulary, ["corpus", "term"], "left_semi").groupBy("corpus", "chunk_id", *extra, "size", "term").agg(F.count("*").alias("tf"))
    return keep(held, "terms")


def bm25(questions: DataFrame, terms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(question_id, corpus, chunk_id, score)`` of the chunks that share a term with a question to their corpus.

    ``questions(question_id, corpus, tokens)``, ``terms`` as ``counted_terms`` gives them; a corpus has its own
    statistics. Repeated question tokens count again.
    """
    asked = term_counts(questions, ["question_id", "corpus"]).withColumnRenamed("tf", "qtf")
    stats = terms.where("term = ''").groupBy("corpus").agg(F.count("*").alias("n"), F.avg("size").alias("mean_size"))
    tf = terms.where("term <> ''")
    df = tf.groupBy("corpus", "term").agg(F.count("*").alias("df")).join(stats, "corpus")
    weighed = tf.join(df, ["corpus", "term"])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean_size")))
    weighed = weighed.select("corpus", "chunk_id", "term", part.alias("part"))
    return weighed.join(asked, ["corpus", "term"]).groupBy("question_id", "corpus", "chunk_id").agg(F.sum(F.col("qtf") * F.col("part")).alias("score"))


def bm25_top(questions: DataFrame, chunks: DataFrame, k: int, page_cap: int | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The ``k`` best chunks of each question's corpus, zero scores kept, at most ``page_cap`` of a page.

    ``chunks(corpus, chunk_id, tokens)``, with page_index too where a cap is given. Chunks without a shared term all
    score zero and go by chunk_id, so a corpus' first k (under a cap: the first ``page_cap`` of each of its first k
    pages) hold all of them that can be among the best.
    """
    keys = ["corpus", "chunk_id", *(["page_index"] if page_cap else [])]
    terms = counted_terms(questions, chunks, keys[2:])
    scored, first = bm25(questions, terms, k1, b), terms.where("term = ''").select(*keys)
    if page_cap:
        scored = scored.join(first, ["corpus", "chunk_id"]).select("question_id", *keys, "score")
        first = top_k(first, ["corpus", "page_index"], [F.col("chunk_id").asc()], page_cap, "in_page")
    # a scored chunk may stand in the way of an unscored one, at most k times
    first = top_k(first, ["corpus"], [F.col("chunk_id").asc()], 2 * k, "place").select(*keys)
    filled = questions.select("question_id", "corpus").distinct().join(first, "corpus").select("question_id", *keys, F.lit(0.0).alias("score"))
    rows = scored.select("question_id", *keys, "score").unionByName(filled).groupBy("question_id", *keys).agg(F.max("score").alias("score"))
    order = [F.round("score", 9).desc(), F.col("chunk_id").asc()]
    if page_cap:
        rows = top_k(rows, ["question_id", "corpus", "page_index"], order, page_cap, "of_page")
    return top_k(rows, ["question_id", "corpus"], order, k).select("question_id", "corpus", "rank", "chunk_id", "score")


def vector_top_k(
    queries: DataFrame, pages: DataFrame, k: int, mean: bool = False, same_group: bool = False, skip_self: bool = False, per_group: bool = False, query_block: int = 16_384, page_block: int = 16_384
) -> DataFrame:
    """``(query_id, page_id, score, rank)``: the ``k`` best pages of each query by late interaction.

    ``queries(query_id, vecs[, grp])`` and ``pages(page_id, vecs[, grp])`` hold arrays of vectors; one vector makes it a
    dense search. The score is the sum over query vectors of the largest product with a page vector (``mean``: the
    mean of cosines). ``same_group`` compares equal ``grp`` only, ``skip_self`` leaves out a page of the query's id, and
    ``per_group`` ranks the pages of each ``grp`` apart and returns it too.

    Queries and pages are dealt by a hash into blocks of about ``query_block`` and ``page_block`` vectors, within their
    group under ``same_group``; each pair of blocks is one group of a task, whose products are formed some queries at a
    time and from which k rows a query leave. So a task's memory is bounded, no vector passes the driver, and other
    groups' products are never formed. Queries are read once for each block of pages and pages once for each block of queries.
    """
    keys = ["query_id", "grp"] if per_group else ["query_id"]
    of = F.col("grp").cast("string") if same_group else F.lit("")
    blocks = lambda rows, size, name: rows.groupBy(of.alias("of")).agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("vecs")) / size)).cast("int").alias(name))
    shape = blocks(queries, query_block, "nq").join(blocks(pages, page_block, "np"), "of")
    page_columns = ["page_id", "vecs", *(["grp"] if per_group else [])]
    dealt = lambda rows, columns, id_, own, n_own, other, n_other: (
        rows.select(*columns, of.alias("of")).join(shape, "of")
        .withColumn(own, F.pmod(F.xxhash64(id_), F.col(n_own)).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
        .select("of", "qb", "pb", *columns)
    )
    left = dealt(queries.select("query_id", F.col("vecs").alias("query_vecs"), *(["grp"] if same_group else [])), ["query_id", "query_vecs"], "query_id", "qb", "nq", "pb", "np")
    right = dealt(pages, page_columns, "page_id", "pb", "np", "qb", "nq")
    kinds = T.StructType([queries.schema["query_id"], pages.schema["page_id"], T.StructField("score", T.DoubleType()), *([pages.schema["grp"]] if per_group else [])])
    pair = ["of", "qb", "pb"]
    found = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(_scorer(k, mean, skip_self, per_group), kinds)
    return top_k(found, keys, [F.round("score", 9).desc(), F.col("page_id").asc()], k)


def matrix(column: pa.Array | pa.ChunkedArray, unit: bool) -> tuple[np.ndarray, np.ndarray]:
    """All vectors of a column of arrays of vectors, and how many each row has."""
    vecs = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = pa.compute.fill_null(pa.compute.list_value_length(vecs), 0).to_numpy(zero_copy_only=False)
    flat = vecs.flatten()
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if unit else x), counts


def best_of(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest values of each row; of equal ones the first columns."""
    s = -np.round(score, 9)
    if k < s.shape[1]:
        row, col = np.nonzero(s <= np.partition(s, k - 1, axis=1)[:, k - 1 : k])
    else:
        row, col = np.divmod(np.arange(s.size), s.shape[1])
    order = np.lexsort((col, s[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    fits = (place < k) & np.isfinite(s[row, col])
    return row[fits], col[fits]


def _scorer(k: int, mean: bool, skip_self: bool, per_group: bool):
    def run(queries: pa.Table, pages: pa.Table) -> pa.Table:
        names = ["query_id", "page_id", "score", *(["grp"] if per_group else [])]
        empty = pa.table([queries["query_id"].slice(0, 0), pages["page_id"].slice(0, 0), pa.array([], pa.float64()), *([pages["grp"].slice(0, 0)] if per_group else [])], names=names)
        pages = pages.filter(pa.compute.fill_null(pa.compute.greater(pa.compute.list_value_length(pages["vecs"]), 0), False)).sort_by("page_id")
        queries = queries.filter(pa.compute.fill_null(pa.compute.greater(pa.compute.list_value_length(queries["query_vecs"]), 0), False))
        if not len(pages) or not len(queries):
            return empty
        (q, n_q), (p, n_p) = matrix(queries["query_vecs"], mean), matrix(pages["vecs"], mean)
        starts, firsts = np.cumsum(n_q) - n_q, np.cumsum(n_p) - n_p
        page_ids, query_ids = pages["page_id"].to_numpy(), queries["query_id"].to_numpy()
        groups = pages["grp"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) if per_group else np.zeros(len(pages), np.int64)
        out, step = [], max(1, 1_000_000 * len(queries) // (len(q) * len(p)))
        for a in range(0, len(queries), step):  # some queries at a time: products of all vectors aren't held at once
            b = min(len(queries), a + step)
            dots = q[starts[a] : starts[b - 1] + n_q[b - 1]] @ p.T
            score = np.add.reduceat(np.maximum.reduceat(dots, firsts, axis=1), starts[a:b] - starts[a], axis=0)
            if mean:
                score /= n_q[a:b, None]
            if skip_self:
                score[query_ids[a:b, None] == page_ids[None, :]] = -np.inf
            for g in np.unique(groups):
                at = np.flatnonzero(groups == g)
                row, col = best_of(score[:, at], k)
                out.append((a + row, at[col], score[row, at[col]]))
        row, col, score = (np.concatenate(x) for x in zip(*out, strict=True))
        columns = [queries["query_id"].take(pa.array(row)), pages["page_id"].take(pa.array(col)), pa.array(score), *([pages["grp"].take(pa.array(col))] if per_group else [])]
        return pa.table(columns, names=names)

    return run


def phrase_rank(questions: DataFrame, notes: DataFrame, k: int, question_block: int = 512, note_block: int = 20_000) -> DataFrame:
    """``(question_id, note_id, score, rank)``: the ``k`` best notes of each question that have any of its terms. The score counts distinct terms
    found, plus a hundredth of all their occurrences.

    ``questions(question_id, terms)`` of single words, ``notes(note_id, tokens)``. Notes are cut to the asked words, one row a note, and
    dealt into blocks of about ``note_block``, questions into blocks of about ``question_block``; a task counts the words of a block of notes
    and adds up those of a block of questions, and ``k`` rows a question leave. So no row is made for a question and a note.
    """
    terms = keep(questions.select("question_id", F.explode(F.array_distinct("terms")).alias("term")), "phrase-terms")
    vocabulary = terms.select(F.col("term").alias("asked_term")).distinct()
    words = notes.select("note_id", F.explode("tokens").alias("term")).join(vocabulary, F.col("term") == F.col("asked_term"), "left_semi")
    found = keep(words.groupBy("note_id", "term").agg(F.count("*").alias("tf")), "phrase-counts")
    shape = terms.agg(F.ceil(F.countDistinct("question_id") / question_block).alias("nq")).crossJoin(found.agg(F.ceil(F.approx_count_distinct("note_id") / note_block).alias("nn"))).first()
    nq, nn = (max(1, int(n or 0)) for n in shape)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = terms.select(F.pmod(F.xxhash64("question_id"), F.lit(nq)).cast("int").alias("qb"), all_of(nn).alias("nb"), "question_id", "term")
    of = terms.select("term", F.pmod(F.xxhash64("question_id"), F.lit(nq)).cast("int").alias("qb")).distinct()
    right = found.join(of, "term").select("qb", F.pmod(F.xxhash64("note_id"), F.lit(nn)).cast("int").alias("nb"), "note_id", "term", "tf")
    kinds = T.StructType([questions.schema["question_id"], notes.schema["note_id"], T.StructField("score", T.DoubleType())])
    best = left.groupBy("qb", "nb").cogroup(right.groupBy("qb", "nb")).applyInArrow(_phrase_scorer(k), kinds)
    return top_k(best, ["question_id"], [F.round("score", 9).desc(), F.col("note_id").asc()], k)


def _phrase_scorer(k: int):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        questions, notes = (t[c].combine_chunks().dictionary_encode() for t, c in ((asked, "question_id"), (held.sort_by("note_id"), "note_id")))
        if asked.num_rows and held.num_rows:
            held = held.sort_by("note_id")
            words = asked["term"].combine_chunks().unique()
            at = pa.compute.index_in(held["term"].combine_chunks(), words).to_numpy(zero_copy_only=False)
            note, tf = notes.indices.to_numpy(), held["tf"].to_numpy()
            question = questions.indices.to_numpy()
            order = np.argsort(question, kind="stable")
            term = pa.compute.index_in(asked["term"].combine_chunks(), words).to_numpy()[order]
            first = np.searchsorted(question[order], np.arange(len(questions.dictionary)))
            step = max(1, 2_000_000 // max(len(words), len(term)))
            for a in range(0, len(notes.dictionary), step):  # some notes at a time
                b = min(a + step, len(notes.dictionary))
                i, j = np.searchsorted(note, (a, b))
                counts = np.zeros((len(words), b - a), np.int64)
                counts[at[i:j], note[i:j] - a] = tf[i:j]
                n, total = (np.add.reduceat(x[term], first, axis=0) for x in ((counts > 0).astype(np.int64), counts))
                row, col = best_of(np.where(n > 0, n + 0.01 * total, -np.inf), k)
                out.append((row, a + col, (n + 0.01 * total)[row, col]))
        row, col, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([questions.dictionary.take(pa.array(row)), notes.dictionary.take(pa.array(col)), pa.array(score)], names=["question_id", "note_id", "score"])

    return run


def keywords(questions: DataFrame, stop: list[str], least: int = 2, k: int = 8) -> DataFrame:
    """``(question_id, rank, term)``: the most frequent words that are no stop words, first seen first."""
    words = questions.select("question_id", F.posexplode("tokens").alias("pos", "term")).where((F.length("term") >= least) & ~F.col("term").isin(stop))
    counts = words.groupBy("question_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return top_k(counts, ["question_id"], [F.col("n").desc(), F.col("first").asc()], k).select("question_id", "rank", "term", "n")


def hybrid(semantic: DataFrame, keyword: DataFrame, by: str, item: str) -> DataFrame:
    """Two ranked lists of ``(by, item, rank)`` one after the other; a later repeat of an item goes."""
    both = semantic.select(by, item, F.col("rank").alias("ordinal"), F.lit(0).alias("list")).unionByName(keyword.select(by, item, F.col("rank").alias("ordinal"), F.lit(1).alias("list")))
    once = both.groupBy(by, item).agg(F.min(F.struct("list", "ordinal")).alias("first"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("first", item))).select(by, "rank", item, F.col("first.list").alias("list"))


def pack(blocks: DataFrame, by: list[str], rank: str, size: str, budget: int) -> DataFrame:
    """The blocks of each group, by rank, before the first that would go over the budget."""
    used = F.sum(size).over(Window.partitionBy(*by).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return blocks.withColumn("used", used).where(F.col("used") <= budget)


def page_scores(items: DataFrame, by: list[str], pages: str, score: str) -> DataFrame:
    """The best score of each page that items cover."""
    return items.select(*by, F.explode(pages).alias("page_index"), score).groupBy(*by, "page_index").agg(F.max(score).alias(score))


def link_expansion(ranked: DataFrame, notes: DataFrame, k: int, links: int = 3) -> DataFrame:
    """Walks ranked notes, each followed by its first links; every note counts where it first comes, up to ``k``.

    ``ranked(question_id, rank, note_id)``, ``notes(note_id, links)``.
    """
    walked = ranked.join(notes.select(F.col("note_id").alias("n"), "links"), F.col("note_id") == F.col("n"))
    steps = walked.select("question_id", "rank", F.posexplode(F.concat(F.array("note_id"), F.slice(F.coalesce("links", F.array().cast("array<bigint>")), 1, links))).alias("pos", "note"))
    first = steps.groupBy("question_id", "note").agg(F.min(F.struct("rank", "pos")).alias("at"))
    return top_k(first, ["question_id"], [F.col("at").asc(), F.col("note").asc()], k, "place").select("question_id", "place", F.col("note").alias("note_id"))


def mean_vector(vectors: DataFrame, by: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """Weighted mean of each group's vectors, dimension by dimension: sum(w v) / max(sum w, 1e-9)."""
    w = weight if weight is not None else F.lit(1.0)
    parts = vectors.withColumn("w", w).select(*by, "w", F.posexplode(vector).alias("dim", "v"))
    sums = parts.groupBy(*by, "dim").agg((F.sum(F.col("w") * F.col("v").cast("double")) / F.greatest(F.sum("w"), F.lit(1e-9))).alias("v"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("vec"))


def cell_search(queries: DataFrame, pages: DataFrame, k: int, cells: int, probes: int, sample: int = 20_000) -> DataFrame:
    """``(query_id, page_id, score, rank)``: the best of the pages in the ``probes`` cells nearest to each query: an approximate ranking.

    Cells are the nearest of ``cells`` centroids, fitted by k-means to about ``sample`` pages; every page is in the index. One vector a
    row, as ``vector_top_k`` takes it; a query meets the pages of its cells by an equi-join, in blocks.
    """
    centroids = _fit_cells(pages, cells, sample)
    near = lambda rows, id_, n: rows.select(id_, "vecs", F.explode(_nearest_cells(centroids, n)("vecs")).alias("grp"))
    found = vector_top_k(near(queries, "query_id", probes), near(pages, "page_id", 1), k, same_group=True)
    return top_k(found.drop("rank"), ["query_id"], [F.round("score", 9).desc(), F.col("page_id").asc()], k)


def _fit_cells(pages: DataFrame, cells: int, sample: int) -> np.ndarray:
    share = min(1.0, sample / max(1, pages.count()))
    drawn = pages.where(F.shiftrightunsigned(F.xxhash64("page_id"), 11) / F.lit(float(1 << 53)) < share).orderBy("page_id").select(F.col("vecs")[0].alias("v")).toArrow()["v"]
    x = np.array(drawn.to_pylist(), np.float64)
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy() if len(x) else np.zeros((1, 1))
    for _ in range(10 if len(x) else 0):
        home = (x @ c.T).argmax(1)
        for j in np.unique(home):
            mean = x[home == j].mean(0)
            c[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return c


def _nearest_cells(centroids: np.ndarray, n: int):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def nearest(vecs: pd.Series) -> pd.Series:
        x = np.array([v[0] for v in vecs], np.float64)
        return pd.Series(list(np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :n].astype(np.int32)))

    return nearest
