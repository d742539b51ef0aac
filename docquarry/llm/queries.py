"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import ann, bpe, chat, decontaminate, embedding_dedup, langid, line_dedup, periodic, quality, simhash, token_store, url_filter, whitening


def tokenizer(name: str) -> str:
    """The place of a vocabulary file; ``/opt/tokenizers`` where the package isn't installed."""
    try:
        import public_tokenizers
    except ImportError:
        return f"/opt/tokenizers/{name}"
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.host_path_rule(verdict, name) for verdict, name in URL_RULES]
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digests(chat.examples(rows.unionByName(planted)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)``; with h = crc32 of the decimal doc_id, each tenth text (h % 10 = 0) goes on periodically from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')")))
    some = some.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    some = some.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    # the first a words, then the next p again and again
    period = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), period), " ")
    return some.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    better = "r.length * m.period > m.length * r.period"
    best = F.expr(f"aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (m, r) -> if(m is null or {better}, r, m))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}") for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("collapsed_sha256"),
    )


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_bpe, op3_token_store, op4_simhash, op5_langid, op6_quality, op7_embedding_dedup, op8_url_filter, op9_chat, op10_line_dedup, op11_whitening, op12_periodic_runs, op13_nearest_neighbours)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT DISTINCT dw.doc_id, dw.size, dw.i, win.item_id FROM dw JOIN win ON dw.size = win.size AND dw.win = win.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, size, i FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op13_nearest_neighbours": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_reduce(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_url_filter": f"""
WITH p AS (SELECT page_id, coalesce({_LOWER.format("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{n}', '{n.partition('/')[0]}', '/{n.partition('/')[2]}')" for v, n in URL_RULES)}) t(verdict, rule, rule_host, rule_path)),
best AS (SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(r.verdict, length(rule)) AS verdict
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict,
  CASE WHEN regexp_matches(p.host || p.path, '^(?:[^/]*\\.)?(?:spam-farm|cheap-pills)\\.') OR regexp_matches(p.host || p.path, '^(?:[^/]*[.-])?casino[.-]')
    OR regexp_matches(p.host || p.path, '^(?:[^/]*\\.)?(?:free-bets|adult-[^./]*|ads-track[^./]*)\\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id, host, path)""",
}


def _chat_sql() -> str:
    escaped = "replace(said, '␛', '␛e')"
    for control, letter in chat.CONTROLS:
        escaped = f"replace({escaped}, '{control}', '␛{letter}{control[1:]}')"
    return f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
t AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
  length({escaped}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 13 ELSE 16 + length(role) END AS size
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said)),
u AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY pos) AS so_far FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(said)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(said, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(so_far) FILTER (role = 'assistant' OR pos = n))::BIGINT AS formatted_chars
FROM u GROUP BY conv_id"""


ORACLE_SQL["op9_chat"] = _chat_sql()
