"""Queries of retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import contexts, indexes
from docquarry.operators import retrieval as op
from docquarry.plans.common import SQL_CHUNKS, SQL_PAGES, SQL_QUESTIONS, Registry, asked, documents_as_chunks, page_vectors, questions, single_vectors, sql_tokens, table

R = Registry()

SQL_BM25 = f"""{SQL_QUESTIONS}, {SQL_CHUNKS},
q AS (SELECT question_id, corpus, term, count(*) AS qtf FROM (SELECT question_id, corpus, unnest(tokens) AS term FROM questions) GROUP BY ALL),
s AS (SELECT corpus, count(*) AS n, avg(len(tokens)) AS mean_size FROM chunks GROUP BY corpus),
tf AS (SELECT corpus, chunk_id, size, term, count(*) AS tf FROM (SELECT corpus, chunk_id, len(tokens) AS size, unnest(tokens) AS term FROM chunks) GROUP BY ALL),
df AS (SELECT corpus, term, count(*) AS df FROM tf GROUP BY ALL),
scored AS (SELECT question_id, corpus, chunk_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean_size))) AS score
  FROM q JOIN tf USING (corpus, term) JOIN df USING (corpus, term) JOIN s USING (corpus) GROUP BY ALL),
filled AS (SELECT question_id, corpus, chunk_id, coalesce(score, 0) AS score FROM questions JOIN chunks USING (corpus)
  LEFT JOIN scored USING (question_id, corpus, chunk_id))"""


@R.add(
    "r01_r02_bm25_top3",
    f"""WITH {SQL_BM25}, ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id, corpus ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM filled)
SELECT question_id, corpus, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 3""",
)
def bm25_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.bm25_top(questions(spark, sf_dir), documents_as_chunks(spark, sf_dir), 3)
    return found.withColumn("score", F.round("score", 6))


@R.add(
    "r02_bm25_page_cap",
    f"""WITH {SQL_BM25}, of_page AS (SELECT *, row_number() OVER (PARTITION BY question_id, corpus, chunk_id // 100 ORDER BY round(score, 9) DESC, chunk_id) AS p FROM filled),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id, corpus ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM of_page WHERE p <= 1)
SELECT question_id, corpus, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 5""",
)
def bm25_page_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = documents_as_chunks(spark, sf_dir).withColumn("page_index", F.floor(F.col("chunk_id") / 100))
    return op.bm25_top(questions(spark, sf_dir), chunks, 5, page_cap=1).withColumn("score", F.round("score", 6))


SQL_DENSE = """qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS ql FROM embeddings WHERE vec_id % 50 = 0),
pv AS (SELECT vec_id AS page_id, embedding::DOUBLE[] AS v, label FROM embeddings)"""


def _ranked(source: str, k: int, extra: str = "") -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_id) AS rank FROM ({source}))
SELECT query_id, rank::INT AS rank, page_id, round(score, 6) AS score FROM ranked WHERE rank <= {k}"""


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "page_id", F.round("score", 6).alias("score"))


@R.add("r03_dense_masked_top5", f"WITH {SQL_DENSE}, {_ranked('SELECT query_id, page_id, list_dot_product(q, v) AS score FROM qv JOIN pv ON ql = label', 5)}")
def dense_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = single_vectors(spark, sf_dir)
    return _shown(op.vector_top_k(asked(pages), pages, 5, same_group=True))


SQL_SIMS = f"""{SQL_PAGES}, sims AS (SELECT q.page_id AS query_id, q.tok AS qt, p.page_id, max(SIM(q.v, p.v)) AS best
  FROM pages4 q, pages4 p WHERE q.page_id % 50 = 0 GROUP BY ALL)"""


@R.add("r04_r05_maxsim_sum", f"WITH {SQL_SIMS.replace('SIM', 'list_dot_product')}, {_ranked('SELECT query_id, page_id, sum(best) AS score FROM sims GROUP BY ALL', 5)}")
def maxsim_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_vectors(spark, sf_dir)
    return _shown(op.vector_top_k(asked(pages), pages, 5))


@R.add("r06_maxsim_mean_cosine", f"WITH {SQL_SIMS.replace('SIM', 'list_cosine_similarity')}, {_ranked('SELECT query_id, page_id, avg(best) AS score FROM sims GROUP BY ALL', 5)}")
def maxsim_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_vectors(spark, sf_dir)
    return _shown(op.vector_top_k(asked(pages), pages, 5, mean=True))


@R.add(
    "r07_token_ann_maxsim",
    f"""WITH {SQL_PAGES}, s AS (SELECT q.page_id AS query_id, q.tok AS qt, p.page_id, p.page_id * 4 + p.tok AS token, list_dot_product(q.v, p.v) AS score FROM pages4 q, pages4 p WHERE q.page_id % 50 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id, qt ORDER BY round(score, 9) DESC, token) AS r FROM s),
best AS (SELECT query_id, qt, page_id, max(score) AS best FROM top WHERE r <= 20 GROUP BY ALL), {_ranked('SELECT query_id, page_id, sum(best) AS score FROM best GROUP BY ALL', 5)}""",
)
def token_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query token's 20 nearest tokens, the best of each page, summed: only pages that were hit appear."""
    tokens = single_vectors(spark, sf_dir)
    near = op.vector_top_k(tokens.where(F.floor(F.col("page_id") / 4) % 50 == 0).withColumnRenamed("page_id", "query_id"), tokens, 20)
    best = near.groupBy(F.floor(F.col("query_id") / 4).alias("q"), F.col("query_id").alias("token"), F.floor(F.col("page_id") / 4).alias("page_id")).agg(F.max("score").alias("score"))
    pages = best.groupBy(F.col("q").alias("query_id"), "page_id").agg(F.sum("score").alias("score"))
    return _shown(op.top_k(pages, ["query_id"], [F.round("score", 9).desc(), F.col("page_id").asc()], 5))


@R.add("r07_pruned_maxsim")
def pruned_maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by late interaction, full scores for candidates of token centroids only: a test holds it to the exact ranking."""
    pages = page_vectors(spark, sf_dir)
    return _shown(indexes.pruned_maxsim(asked(pages).select("query_id", "vecs"), pages.select("page_id", "vecs"), 5, cells=64, probes=24, candidates=100))


@R.add("r08_r12_dense_global_top10", f"WITH {SQL_DENSE}, {_ranked('SELECT query_id, page_id, list_dot_product(q, v) AS score FROM qv, pv', 10)}")
def dense_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task keeps its best rows, and a final cut follows: shards' rankings merged."""
    pages = single_vectors(spark, sf_dir)
    return _shown(op.vector_top_k(asked(pages), pages, 10))


@R.add(
    "r09_best_page_per_document",
    f"""WITH {SQL_DENSE}, s AS (SELECT query_id, page_id, label, list_dot_product(q, v) AS score FROM qv, pv),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY round(score, 9) DESC, page_id) AS of_doc FROM s), {_ranked('SELECT query_id, page_id, score FROM best WHERE of_doc = 1', 4)}""",
)
def best_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best page of each document, and the best four of these."""
    pages = single_vectors(spark, sf_dir)
    found = op.vector_top_k(asked(pages), pages, 1, per_group=True)
    return _shown(op.top_k(found.drop("rank"), ["query_id"], [F.round("score", 9).desc(), F.col("page_id").asc()], 4))


@R.add("r13_self_retrieve", f"WITH {SQL_DENSE}, {_ranked('SELECT query_id, page_id, list_dot_product(q, v) AS score FROM qv JOIN pv ON page_id % 50 = 0', 3)}")
def self_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries against queries, themselves included."""
    queries = asked(single_vectors(spark, sf_dir))
    return _shown(op.vector_top_k(queries, queries.withColumnRenamed("query_id", "page_id"), 3))


@R.add("r15_cosine_notes", f"WITH {SQL_DENSE}, {_ranked('SELECT query_id, page_id, list_cosine_similarity(q, v) AS score FROM qv, pv WHERE query_id <> page_id', 5)}")
def cosine_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = single_vectors(spark, sf_dir)
    return _shown(op.vector_top_k(asked(pages), pages, 5, mean=True, skip_self=True))


@R.add(
    "r14_merge_by_score",
    """WITH lists AS (SELECT 0 AS src, user_id AS q, event_id AS d, value FROM events WHERE event_type = 'click' UNION ALL SELECT 1, user_id, event_id, value * 2 FROM events WHERE event_type IN ('click', 'view')),
one AS (SELECT q, d, arg_min(value, src) AS value FROM lists GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(value, 9) DESC, d) AS rank FROM one)
SELECT q, rank::INT AS rank, d, round(value, 6) AS value FROM r WHERE rank <= 10""",
)
def merge_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings: the first list's score of a pair stands, and the best ten of each query stay."""
    events = table(spark, sf_dir, "events")
    one = events.where("event_type = 'click'").select(F.lit(0).alias("src"), F.col("user_id").alias("q"), F.col("event_id").alias("d"), "value")
    two = events.where("event_type in ('click', 'view')").select(F.lit(1).alias("src"), F.col("user_id").alias("q"), F.col("event_id").alias("d"), (F.col("value") * 2).alias("value"))
    merged = one.unionByName(two).groupBy("q", "d").agg(F.min_by("value", "src").alias("value"))
    return op.top_k(merged, ["q"], [F.round("value", 9).desc(), F.col("d").asc()], 10).select("q", "rank", "d", F.round("value", 6).alias("value"))


#: Words without weight in questions of the fixture's languages.
STOP = ["the", "and", "of", "to", "is", "it", "in", "that", "on", "for", "with", "as", "at", "by", "de", "la", "le", "les", "et", "en", "der", "die", "und", "den", "el", "los", "las", "y", "que", "un"]
SQL_STOP = ", ".join(f"'{w}'" for w in STOP)
SQL_KEYWORDS = f"""{SQL_QUESTIONS}, kw AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, first) AS rank FROM (
  SELECT question_id, term, count(*) AS n, min(pos) AS first FROM (SELECT question_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM questions)
  WHERE length(term) >= 2 AND term NOT IN ({SQL_STOP}) GROUP BY ALL))"""


@R.add("r20_keywords", f"WITH {SQL_KEYWORDS} SELECT question_id, rank::INT AS rank, term, n FROM kw WHERE rank <= 8")
def keyword_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keywords(questions(spark, sf_dir), STOP)


SQL_PHRASE = f"""{SQL_KEYWORDS}, notes AS (SELECT doc_id AS note_id, unnest({sql_tokens('text')}) AS term FROM documents), tf AS (SELECT note_id, term, count(*) AS tf FROM notes GROUP BY ALL),
scored AS (SELECT question_id, note_id, count(*) + 0.01::DOUBLE * sum(tf) AS score FROM kw JOIN tf USING (term) WHERE rank <= 8 GROUP BY ALL),
phrase AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, note_id) AS prank FROM scored)"""


def phrases(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    terms = op.keywords(questions(spark, sf_dir), STOP).groupBy("question_id").agg(F.collect_list("term").alias("terms"))
    notes = documents_as_chunks(spark, sf_dir).select(F.col("chunk_id").alias("note_id"), "tokens")
    return op.phrase_rank(terms, notes, k)


@R.add("r17_r18_phrase_rank", f"WITH {SQL_PHRASE} SELECT question_id, prank::INT AS rank, note_id, round(score, 6) AS score FROM phrase WHERE prank <= 5")
def phrase_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(spark, sf_dir, 5).select("question_id", "rank", "note_id", F.round("score", 6).alias("score"))


SQL_HYBRID = f"""WITH {SQL_PHRASE.replace('scored', 'pscored').replace(' tf AS (', ' ptf AS (').replace('JOIN tf USING', 'JOIN ptf USING')}, {SQL_BM25[SQL_BM25.index('chunks AS'):]},
b AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS brank FROM filled),
both_lists AS (SELECT question_id, chunk_id AS note_id, 0 AS list, brank AS ordinal FROM b WHERE brank <= 5 UNION ALL SELECT question_id, note_id, 1, prank FROM phrase WHERE prank <= 3),
one AS (SELECT question_id, note_id, min(list * 100 + ordinal) AS spot FROM both_lists GROUP BY ALL)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY spot, note_id)::INT AS rank, note_id, (spot // 100)::INT AS list FROM one"""


SQL_BUILDERS = f"""{SQL_HYBRID[: SQL_HYBRID.index(",\nboth_lists AS")]} SELECT 'bm25' AS builder, question_id, brank::INT AS rank, chunk_id FROM b WHERE brank <= 3 UNION ALL SELECT 'phrase', question_id, prank::INT, note_id FROM phrase WHERE prank <= 3"""


@R.add("x_context_builders", SQL_BUILDERS)
def context_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension surface: two builders run by name."""
    asks, docs = questions(spark, sf_dir), documents_as_chunks(spark, sf_dir)
    one = contexts.build("bm25", asks, docs, 3).select(F.lit("bm25").alias("builder"), "*")
    return one.unionByName(contexts.build("phrase", asks, docs, 3, stop=tuple(STOP)).select(F.lit("phrase").alias("builder"), "*"))


@R.add("r19_hybrid_merge", SQL_HYBRID)
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25's five best of the question's source, then the phrase rank's three best of all; repeats go."""
    best = op.bm25_top(questions(spark, sf_dir), documents_as_chunks(spark, sf_dir), 5).select("question_id", F.col("chunk_id").alias("note_id"), "rank")
    words = phrases(spark, sf_dir, 3).select("question_id", "note_id", "rank")
    return op.hybrid(best, words, "question_id", "note_id")


@R.add(
    "r16_link_expansion",
    f"""WITH {SQL_DENSE}, r AS (SELECT query_id AS question_id, page_id AS note_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q, v), 9) DESC, page_id) AS rank FROM qv, pv),
steps AS (SELECT question_id, rank, unnest([note_id, note_id + 1, note_id + 2, note_id + 3]) AS note, unnest([0, 1, 2, 3]) AS pos FROM r WHERE rank <= 30),
f AS (SELECT question_id, note, min(rank * 10 + pos) AS spot FROM steps GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY spot, note) AS place FROM f)
SELECT question_id, place::INT AS place, note AS note_id FROM p WHERE place <= 10""",
)
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 nearest notes, each followed by its links: here the three notes after it."""
    pages = single_vectors(spark, sf_dir)
    ranked = op.vector_top_k(asked(pages), pages, 30).select(F.col("query_id").alias("question_id"), "rank", F.col("page_id").alias("note_id"))
    notes = pages.select(F.col("page_id").alias("note_id"), F.array(*[F.col("page_id") + i for i in (1, 2, 3, 4)]).alias("links"))
    return op.link_expansion(ranked, notes, 10)


@R.add(
    "r21_lexical_occurrences",
    f"""WITH {SQL_KEYWORDS}, n AS (SELECT source, doc_id, lower(text) AS h FROM documents),
t AS (SELECT question_id, 'src' || (question_id % 20) AS corpus, term FROM kw WHERE rank <= 8),
s AS (SELECT question_id, doc_id, sum((length(h) - length(replace(h, term, ''))) // length(term)) AS score FROM t JOIN n ON corpus = source GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT question_id, rank::INT AS rank, doc_id, score::BIGINT AS score FROM r WHERE rank <= 8""",
)
def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of the question's terms as substrings of the documents of its source."""
    terms = op.keywords(questions(spark, sf_dir), STOP).select("question_id", "term", F.concat(F.lit("src"), (F.col("question_id") % 20).cast("string")).alias("corpus"))
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("corpus"), "doc_id", F.lower("text").alias("h"))
    counts = indexes.substring_counts(docs, terms.select("corpus", "term"), "doc_id")
    scored = terms.join(counts, ["corpus", "term"]).groupBy("question_id", "doc_id").agg(F.sum("n").alias("score"))
    return op.top_k(scored, ["question_id"], [F.col("score").desc(), F.col("doc_id").asc()], 8).select("question_id", "rank", "doc_id", "score")


@R.add(
    "r24_context_packing",
    f"""WITH {SQL_BM25}, b AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM filled),
p AS (SELECT question_id, rank, chunk_id, sum(length(text)) OVER (PARTITION BY question_id ORDER BY rank) AS used FROM b JOIN documents ON doc_id = chunk_id WHERE rank <= 10)
SELECT question_id, rank::INT AS rank, chunk_id, used::BIGINT AS used FROM p WHERE used <= 6000""",
)
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = op.bm25_top(questions(spark, sf_dir), documents_as_chunks(spark, sf_dir), 10).select("question_id", "rank", "chunk_id")
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.length("text").cast("long").alias("size"))
    return op.pack(ranked.join(sizes, "chunk_id"), ["question_id"], "rank", "size", 6000).select("question_id", "rank", "chunk_id", "used")


@R.add(
    "r25_best_score_per_page",
    """SELECT p AS page_index, round(max(value), 6) AS value, user_id FROM (SELECT user_id, value, unnest(range(event_id % 7, event_id % 7 + 3)) AS p FROM events) GROUP BY ALL""",
)
def best_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that cover three pages each: the best score of each page."""
    first = F.col("event_id") % 7
    items = table(spark, sf_dir, "events").select("user_id", F.sequence(first, first + 2).alias("pages"), "value")
    return op.page_scores(items, ["user_id"], "pages", "value").select("user_id", "page_index", F.round("value", 6).alias("value"))


@R.add(
    "r30_weighted_mean_vector",
    """WITH p AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v, vec_id % 3 AS w FROM embeddings)
SELECT label, dim::INT AS dim, round(sum(w * v) / greatest(sum(w), 1e-9), 6) AS v FROM p GROUP BY ALL""",
)
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask-weighted mean of each label's vectors, in long form."""
    means = op.mean_vector(table(spark, sf_dir, "embeddings"), ["label"], "embedding", (F.col("vec_id") % 3).cast("double"))
    return means.select("label", F.posexplode("vec").alias("dim", "v")).select("label", "dim", F.round("v", 6).alias("v"))


@R.add(
    "r11_reduce_embeddings",
    """WITH p AS (SELECT vec_id // 4 AS page_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT page_id, dim::INT AS dim, round(avg(v), 6) AS v FROM p GROUP BY ALL""",
)
def reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("page_id"), "embedding")
    return op.mean_vector(rows, ["page_id"], "embedding").select("page_id", F.posexplode("vec").alias("dim", "v")).select("page_id", "dim", F.round("v", 6).alias("v"))
