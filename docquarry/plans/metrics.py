"""Queries of metrics, the result store and analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import scoring as fn
from docquarry.operators import metrics as op
from docquarry.operators import results as rs
from docquarry.plans.common import Registry, table
from docquarry.plans.scoring import SQL_SCORES, scores

R = Registry()

#: Labelled documents as answers: quality is the score, an answerable question is one that isn't toxic.
SQL_ANSWERS = "a AS (SELECT doc_id, lang, source, quality::DOUBLE AS score, toxic = 0 AS answerable, (doc_id % 7) <> 0 AS pred_answerable, doc_id % 4 AS pages FROM labels JOIN documents USING (doc_id))"
SQL_F1 = """count(*) AS n, round(avg(score), 6) AS acc, round(coalesce(sum(score) FILTER (answerable) / nullif(count_if(answerable), 0), 0), 6) AS recall,
  round(coalesce(sum(score) FILTER (answerable) / nullif(count_if(pred_answerable), 0), 0), 6) AS precision"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").cast("double").alias("score"), (F.col("toxic") == 0).alias("answerable"), (F.col("doc_id") % 7 != 0).alias("pred_answerable"), (F.col("doc_id") % 4).alias("pages")
    )


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in columns})


@R.add("m01_acc_f1", f"WITH {SQL_ANSWERS}, m AS (SELECT lang, {SQL_F1} FROM a GROUP BY lang) SELECT *, round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END, 3) AS f1 FROM m")
def acc_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.acc_and_f1(answers(spark, sf_dir), ["lang"]), "acc", "recall", "precision").withColumn("f1", F.round("f1", 3))


@R.add(
    "m02_breakdowns",
    f"""WITH {SQL_ANSWERS}, p AS (SELECT *, CASE WHEN pages = 1 THEN 'single' WHEN NOT answerable THEN 'unanswerable' ELSE 'cross' END AS spread FROM a)
SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, coalesce(spread, '*') AS spread, count(*) AS n, round(avg(score), 6) AS acc FROM p GROUP BY GROUPING SETS ((lang), (source), (spread), ())""",
)
def breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language, source and page spread at once; no pages and answerable counts as cross-page."""
    spread = F.when(F.col("pages") == 1, "single").when(~F.col("answerable"), "unanswerable").otherwise("cross")
    rows = answers(spark, sf_dir).withColumn("spread", spread)
    sets = rows.groupingSets([[F.col("lang")], [F.col("source")], [F.col("spread")], []], F.col("lang"), F.col("source"), F.col("spread"))
    star = lambda c: F.coalesce(c, F.lit("*")).alias(c)
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("acc")).select(star("lang"), star("source"), star("spread"), "n", "acc")


@R.add("m03_rectified_accuracy", f"WITH {SQL_ANSWERS} SELECT source, round(avg(CASE WHEN pred_answerable THEN score ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN pred_answerable THEN score ELSE 0 END) * count(*) / 2325.0::DOUBLE, 6) AS rectified FROM a GROUP BY source")
def rectified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What couldn't be extracted scores 0; rectified by a fixed number of samples."""
    mean = F.avg(F.when(F.col("pred_answerable"), F.col("score")).otherwise(0.0))
    return answers(spark, sf_dir).groupBy("source").agg(F.round(mean, 6).alias("accuracy"), F.round(mean * F.count("*") / 2325, 6).alias("rectified"))


@R.add(
    "m04_fine_grained",
    f"""WITH {SQL_ANSWERS}, c AS (SELECT * FROM (VALUES ('en', 1000.0::DOUBLE), ('fr', 300.0::DOUBLE), ('de', 300.0::DOUBLE), ('es', 200.0::DOUBLE)) t(lang, size))
SELECT c.lang, round(coalesce(sum(score) FILTER (pages = 1), 0) / max(size), 6) AS single, round(coalesce(sum(score) FILTER (pages <> 1), 0) / max(size), 6) AS cross_page FROM c LEFT JOIN a ON a.lang = c.lang GROUP BY c.lang""",
)
def fine_grained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over constant sample counts, not over those observed."""
    sizes = spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for p in (("en", 1000.0), ("fr", 300.0), ("de", 300.0), ("es", 200.0)) for x in p])).alias("lang", "size"))
    part = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.col("score"))), F.lit(0.0)) / F.max("size"), 6)
    return sizes.join(answers(spark, sf_dir), "lang", "left").groupBy("lang").agg(part(F.col("pages") == 1).alias("single"), part(F.col("pages") != 1).alias("cross_page"))


@R.add(
    "m05_m07_first_hits",
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, event_type = 'purchase' AS gold FROM events),
f AS (SELECT user_id, min(rank) FILTER (gold) AS first_hit, count_if(gold) AS n_gold FROM r WHERE rank <= 10 GROUP BY user_id)
SELECT user_id, first_hit::INT AS first_hit, CASE WHEN n_gold = 0 THEN NULL ELSE first_hit <= 5 END AS hit FROM f""",
)
def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's ten best events: the rank of the first purchase, and whether it is among five; null without one."""
    w = Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")
    top = table(spark, sf_dir, "events").withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    hit = top.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("rank"))).alias("first_hit"))
    return hit.withColumn("hit", F.col("first_hit") <= 5)


SQL_IR = """qrels AS (SELECT event_type AS q, event_id AS d, (event_id % 3)::INT AS rel FROM events WHERE event_id % 5 = 0),
run AS (SELECT event_type AS q, event_id AS d, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events),
h AS (SELECT q, d, rank, coalesce(rel, 0) AS rel FROM run LEFT JOIN qrels USING (q, d)),
i AS (SELECT q, sum(CASE WHEN i <= 10 THEN rel / log2(i + 1) ELSE 0 END) AS idcg, count(*) AS relevant FROM (SELECT q, rel, row_number() OVER (PARTITION BY q ORDER BY rel DESC) AS i FROM qrels WHERE rel > 0) GROUP BY q)"""


@R.add(
    "m29_m30_m31_ir_metrics",
    f"""WITH {SQL_IR}, t AS (SELECT q, coalesce(max(CASE WHEN rel > 0 AND rank <= 10 THEN 1.0::DOUBLE / rank END), 0) AS rr, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg, count_if(rank <= 10 AND rel > 0) AS found FROM h GROUP BY q)
SELECT q, round(rr, 6) AS rr, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg, round(coalesce(found / nullif(relevant, 0)::DOUBLE, 0), 6) AS recall FROM t LEFT JOIN i USING (q)""",
)
def ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    qrels = events.where("event_id % 5 = 0").select(F.col("event_type").alias("q"), F.col("event_id").alias("d"), (F.col("event_id") % 3).cast("int").alias("rel"))
    run = events.select(F.col("event_type").alias("q"), F.col("event_id").alias("d"), "value")
    hits = op.first_hits(run, qrels, "q", "d", [F.col("value").desc(), F.col("d").asc()], 10)
    return _rounded(op.ir_metrics(hits, qrels, "q", 10), "rr", "ndcg", "recall")


@R.add(
    "m34_group_advantages",
    """WITH g AS (SELECT event_id, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, sum(value) OVER w AS t, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id))
SELECT event_id, round((value - m) / (s + 1e-6), 3) AS z, round(value - (t - value) / (n - 1) + 1e-9, 4) AS loo, round(value - m + 1e-9, 4) AS centred FROM g WHERE n > 1""",
)
def advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = op.group_advantages(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "value")
    return got.select("event_id", F.round("z", 3).alias("z"), F.round(F.col("loo") + 1e-9, 4).alias("loo"), F.round(F.col("centred") + 1e-9, 4).alias("centred"))


@R.add("m32_m40_usage", "SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS total, round(max(value), 6) AS most, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 6).alias("most"), F.round(F.avg("value"), 6).alias("mean"))


@R.add("m33_lengths", "SELECT lang, avg(n_chars) AS mean_chars, max(n_chars) AS most, min(n_chars) AS least, round(avg(CASE WHEN n_chars >= 5000 THEN 1.0::DOUBLE ELSE 0 END), 6) AS clipped FROM documents GROUP BY lang")
def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.avg("n_chars").alias("mean_chars"), F.max("n_chars").alias("most"), F.min("n_chars").alias("least"), F.round(F.avg((F.col("n_chars") >= 5000).cast("double")), 6).alias("clipped"))


@R.add(
    "m17_m19_overlapping_groups",
    f"""WITH {SQL_SCORES}, p AS (SELECT 'overall' AS part, * FROM s UNION ALL SELECT CASE WHEN score >= 0.999 THEN 'correct' ELSE 'incorrect' END, * FROM s), n AS (SELECT unnest(['overall', 'correct', 'incorrect']) AS part)
SELECT n.part, count(p.event_id) AS n, round(avg(value), 6) AS mean_value, round(sum(value) / nullif(sum(score), 0), 6) AS ratio FROM n LEFT JOIN p USING (part) GROUP BY n.part""",
)
def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"n": F.count("*"), "mean_value": F.round(F.avg("value"), 6), "ratio": F.round(F.try_divide(F.sum("value"), F.sum("score")), 6)}
    found = op.overlapping_groups(scores(spark, sf_dir), F.when(F.col("score") >= 0.999, "correct").otherwise("incorrect"), values, ["correct", "incorrect"])
    return found.withColumn("n", F.coalesce("n", F.lit(0)))


@R.add("m18_stop_reasons", f"WITH {SQL_SCORES} SELECT score >= 0.999 AS correct, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS reason, count(*) AS n FROM s GROUP BY ALL")
def stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).withColumn("reason", F.when(F.col("event_id") % 11 != 0, F.col("event_type")))
    return rows.groupBy((F.col("score") >= 0.999).alias("correct"), "reason").agg(F.count("*").alias("n"))


@R.add("m26_pivot", "SELECT event_type, max(value) FILTER (event_id % 4 = 0) AS m0, max(value) FILTER (event_id % 4 = 1) AS m1, max(value) FILTER (event_id % 4 = 2) AS m2, max(value) FILTER (event_id % 4 = 3) AS m3 FROM events GROUP BY event_type")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("col", F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")))
    return rows.groupBy("event_type").pivot("col", ["m0", "m1", "m2", "m3"]).agg(F.max("value"))


@R.add("m27_inventory", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


#: Orders as result records: market segments are runs, a customer's nation the question's kind.
SQL_RECORDS = "rec AS (SELECT o_orderkey AS line, o_custkey AS question, c_mktsegment AS run, c_nationkey, round(o_totalprice / 1000) / 500 AS score, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("line"), F.col("o_custkey").alias("question"), F.col("c_mktsegment").alias("run"), "c_nationkey", (F.round(F.col("o_totalprice") / 1000) / 500).alias("score"), F.col("o_orderstatus").alias("status")
    )


SQL_COMPACT = f"{SQL_RECORDS}, k AS (SELECT *, min(line) OVER (PARTITION BY question) AS first_line, row_number() OVER (PARTITION BY question ORDER BY line DESC) AS r FROM rec WHERE status <> 'F')"


@R.add("k02_p04_compact", f"WITH {SQL_COMPACT} SELECT question, line, first_line, round(score, 6) AS score FROM k WHERE r = 1")
def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.compact(records(spark, sf_dir), "question", "line", F.col("status") != "F").select("question", "line", "first_line", F.round("score", 6).alias("score"))


@R.add("j01_merge_results", f"WITH {SQL_COMPACT} SELECT c_custkey AS question, coalesce(k.run, 'none') AS run, round(k.score, 6) AS score FROM customer LEFT JOIN (SELECT * FROM k WHERE r = 1) k ON question = c_custkey")
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question"), F.lit("none").alias("run"))
    done = rs.compact(records(spark, sf_dir), "question", "line", F.col("status") != "F").select("question", "run", "score")
    return rs.merge(samples, done, "question").withColumn("score", F.round("score", 6))


@R.add("j02_pending", f"WITH {SQL_COMPACT} SELECT c_custkey AS question FROM customer WHERE c_custkey NOT IN (SELECT question FROM k)")
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question"))
    return rs.pending(samples, records(spark, sf_dir).where("status <> 'F'"), "question")


SQL_PAIRS = """x AS (SELECT user_id, arg_max(value, event_id) AS a FROM events WHERE event_type = 'click' GROUP BY user_id), y AS (SELECT user_id, arg_max(value, event_id) AS b FROM events WHERE event_type = 'view' GROUP BY user_id),
pairs AS (SELECT user_id, a, b, a - b AS delta, CASE WHEN a - b > 1e-9 THEN 'win' WHEN a - b < -1e-9 THEN 'loss' ELSE 'tie' END AS outcome FROM x JOIN y USING (user_id))"""


@R.add("j03_pairwise", f"WITH {SQL_PAIRS} SELECT user_id, round(a, 6) AS score_a, round(b, 6) AS score_b, round(delta, 6) AS delta, outcome FROM pairs")
def pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return _rounded(rs.pairwise(events.where("event_type = 'click'"), events.where("event_type = 'view'"), "user_id", "event_id", "value"), "score_a", "score_b", "delta")


@R.add(
    "j04_m09_pairwise_counts",
    """WITH s AS (SELECT event_type, user_id, arg_max(value, event_id) AS v FROM events GROUP BY ALL), p AS (SELECT b.event_type AS against, a.v - b.v AS d FROM s a JOIN s b USING (user_id) WHERE a.event_type = 'purchase' AND b.event_type <> 'purchase')
SELECT against, count_if(d > 1e-9) AS wins, count_if(d < -1e-9) AS losses, count_if(abs(d) <= 1e-9) AS ties, count(*) AS aligned FROM p GROUP BY against""",
)
def pairwise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run against each other on the questions both have."""
    last = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.max_by("value", "event_id").alias("v"))
    ours = last.where("event_type = 'purchase'").select("user_id", F.col("v").alias("a"))
    d = F.col("a") - F.col("v")
    pairs = last.where("event_type <> 'purchase'").join(ours, "user_id").select(F.col("event_type").alias("against"), F.when(d > 1e-9, "win").when(d < -1e-9, "loss").otherwise("tie").alias("outcome"))
    return rs.outcome_counts(pairs, ["against"])


@R.add("j05_full_outer_runs", "SELECT coalesce(a.u, b.u) AS user_id, coalesce(n_click, 0) AS n_click, coalesce(n_view, 0) AS n_view FROM (SELECT user_id AS u, count(*) AS n_click FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT user_id AS u, count(*) AS n_view FROM events WHERE event_type = 'view' GROUP BY 1) b ON a.u = b.u")
def paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda t, n: table(spark, sf_dir, "events").where(F.col("event_type") == t).groupBy("user_id").agg(F.count("*").alias(n))
    return count("click", "n_click").join(count("view", "n_view"), "user_id", "full").select("user_id", F.coalesce("n_click", F.lit(0)).alias("n_click"), F.coalesce("n_view", F.lit(0)).alias("n_view"))


SQL_RUNS = f"{SQL_RECORDS}, runs AS (SELECT c_nationkey AS benchmark, run, count(*) AS total, count_if(status <> 'F') AS completed, avg(score) FILTER (status <> 'F') AS metric FROM rec GROUP BY ALL)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("status") != "F"
    return records(spark, sf_dir).groupBy(F.col("c_nationkey").alias("benchmark"), "run").agg(F.count("*").alias("total"), F.count_if(done).alias("completed"), F.avg(F.when(done, F.col("score"))).alias("metric"))


@R.add("m10_leaderboard", f"WITH {SQL_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY round(metric, 9) DESC NULLS LAST, completed DESC, run) AS r FROM runs) SELECT benchmark, run, completed, round(metric, 6) AS metric FROM r WHERE r = 1")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.best_runs(runs(spark, sf_dir), ["benchmark"], [F.round("metric", 9).desc_nulls_last(), F.col("completed").desc(), F.col("run")]).select("benchmark", "run", "completed", F.round("metric", 6).alias("metric"))


@R.add(
    "p11_m38_audit",
    f"""WITH {SQL_RUNS} SELECT benchmark, run, CASE WHEN metric IS NULL THEN 'missing_metrics' WHEN completed = 0 THEN 'empty' WHEN completed < total THEN 'partial' WHEN benchmark % 5 = 0 THEN 'invalid_schema' ELSE 'complete' END AS status,
concat_ws(',', CASE WHEN metric IS NULL THEN 'no metrics' END, CASE WHEN completed < total THEN 'not all samples done' END, CASE WHEN benchmark % 5 = 0 THEN 'schema' END) AS warnings FROM runs""",
)
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.audit(runs(spark, sf_dir).withColumn("valid", F.col("benchmark") % 5 != 0)).select("benchmark", "run", "status", F.array_join("warnings", ",").alias("warnings"))


@R.add(
    "m13_highlights",
    f"""WITH {SQL_RUNS}, w AS (SELECT benchmark || run AS name, round(metric, 2) AS metric, completed::DOUBLE AS completed FROM runs), l AS (SELECT name, 'metric' AS metric, metric AS value FROM w UNION ALL SELECT name, 'completed', completed FROM w),
d AS (SELECT *, dense_rank() OVER (PARTITION BY metric ORDER BY value DESC) AS place FROM l WHERE value IS NOT NULL) SELECT name, metric, value, place::INT AS place FROM d WHERE place <= 2""",
)
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = runs(spark, sf_dir).select(F.concat(F.col("benchmark").cast("string"), "run").alias("name"), F.round("metric", 2).alias("metric"), F.col("completed").cast("double").alias("completed"))
    return rs.highlights(wide, "name", ["metric", "completed"])


@R.add("m14_breakdown_rows", f"WITH {SQL_RUNS} SELECT benchmark, run, 'metric' AS category, round(metric * 100, 6) AS value FROM runs WHERE metric IS NOT NULL UNION ALL SELECT benchmark, run, 'share', round(completed / total * 100, 6) FROM runs")
def breakdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = runs(spark, sf_dir).select("benchmark", "run", "metric", (F.col("completed") / F.col("total")).alias("share"))
    return rs.breakdown(wide, ["benchmark", "run"], ["metric", "share"]).withColumn("value", F.round("value", 6))


@R.add("m36_split_ids", "SELECT DISTINCT doc FROM (SELECT unnest([user_id, user_id + 1]) AS doc FROM events)")
def split_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.explode(F.array("user_id", F.col("user_id") + 1)).alias("doc")).distinct()


@R.add("m37_parameter_curve", "SELECT p_size, p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS score FROM part WHERE p_size IS NOT NULL GROUP BY ALL")
def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size is not null").groupBy("p_size", "p_brand").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("score"))


@R.add("p15_allocate_ids", """WITH h AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'q' || lpad((event_id // 3)::VARCHAR, 6, '0') END AS qid FROM events),
m AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r FROM h WHERE qid IS NULL), s AS (SELECT 'q' || lpad(i::VARCHAR, 6, '0') AS qid, row_number() OVER (ORDER BY i) AS r FROM range(0, (SELECT count(*) FROM h)) t(i) WHERE 'q' || lpad(i::VARCHAR, 6, '0') NOT IN (SELECT qid FROM h WHERE qid IS NOT NULL))
SELECT event_id, qid FROM h WHERE qid IS NOT NULL UNION ALL SELECT event_id, s.qid FROM m JOIN s USING (r)""")
def allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids for rows without one, in order, those in use left out."""
    n = F.lpad(F.floor(F.col("event_id") / 3).cast("bigint").cast("string"), 6, "0")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("q"), n)).alias("qid"))
    return rs.allocate_ids(rows, "event_id", "qid", "q", 6)
