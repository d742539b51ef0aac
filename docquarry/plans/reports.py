"""Queries of result analytics: corrections, cases, main tables, sweeps, nested metrics, balanced bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import scoring as fn
from docquarry.operators import metrics as op
from docquarry.operators import results as rs
from docquarry.plans.common import Registry, table
from docquarry.plans.metrics import SQL_RUNS, runs
from docquarry.plans.scoring import SQL_SCORES, scores

R = Registry()

#: Every third answer has a corrected score; of the others every seventh was tried without getting one.
SQL_OUTCOME = """CASE WHEN event_id % 3 <> 0 AND event_id % 7 <> 0 THEN 'not_run' WHEN score >= 0.999 THEN 'skipped_initial_correct' WHEN corrected IS NULL THEN 'correction_error' WHEN score <= 0.001 AND corrected >= 0.999 THEN 'wrong_to_correct' WHEN score <= 0.001 AND corrected <= 0.001 THEN 'wrong_to_wrong'
  WHEN corrected > score AND corrected < 0.999 THEN 'improved_partial' WHEN corrected < score THEN 'regressed' ELSE 'unchanged' END"""
SQL_CORRECTIONS = f"""{SQL_SCORES}, cr AS (SELECT event_id, user_id, event_type, score, event_id % 3 = 0 OR event_id % 7 = 0 AS ran, corrected >= score AS applied, {SQL_OUTCOME} AS outcome, round(corrected - score, 6) AS delta,
  CASE WHEN corrected IS NULL THEN NULL ELSE corrected <> score END AS pred_changed FROM s)"""


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide row for each answer: whether it was corrected, with what outcome, and what that changed."""
    score, corrected, none = F.col("score"), F.col("corrected"), F.lit(None).cast("string")
    rows = scores(spark, sf_dir)
    ran = (F.col("event_id") % 3 == 0) | (F.col("event_id") % 7 == 0)
    outcome = fn.correction_outcome(ran, none, score, corrected, corrected)
    return rows.select(
        "event_id", "user_id", "event_type", "score", ran.alias("ran"), (corrected >= score).alias("applied"), outcome.alias("outcome"), F.round(corrected - score, 6).alias("delta"), (corrected != score).alias("pred_changed")
    )


@R.add("m08_correction_rows", f"WITH {SQL_CORRECTIONS} SELECT event_id, ran, applied, outcome, delta, pred_changed FROM cr")
def correction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections(spark, sf_dir).select("event_id", "ran", "applied", "outcome", "delta", "pred_changed")


SQL_DIAGNOSTICS = """dg AS (SELECT user_id, min(r) FILTER (event_type = 'purchase') AS first_hit, count_if(event_type = 'purchase') > 0 AS has_gold FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) GROUP BY user_id)"""


@R.add("j06_case_rows", f"WITH {SQL_CORRECTIONS}, {SQL_DIAGNOSTICS} SELECT event_id, round(score, 6) AS score, CASE WHEN score >= 0.999 THEN 'correct' WHEN score <= 0.001 THEN 'wrong' ELSE 'partial' END AS bucket, outcome, delta, first_hit::INT AS first_hit, has_gold FROM cr LEFT JOIN dg USING (user_id)")
def case_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their correction and the retrieval diagnostics of their question."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id"))
    ranked = table(spark, sf_dir, "events").withColumn("r", rank)
    gold = F.col("event_type") == "purchase"
    found = ranked.groupBy("user_id").agg(F.min(F.when(gold, F.col("r"))).alias("first_hit"), (F.count_if(gold) > 0).alias("has_gold"))
    return corrections(spark, sf_dir).join(found, "user_id", "left").select("event_id", F.round("score", 6).alias("score"), fn.score_bucket(F.col("score")).alias("bucket"), "outcome", "delta", "first_hit", "has_gold")


SQL_OFFICIAL = f"""{SQL_RUNS}, off AS (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY (completed = total)::INT DESC, CASE WHEN metric = 0 THEN -1.0::DOUBLE ELSE round(metric, 9) END DESC, completed DESC, run DESC) AS r FROM runs WHERE metric IS NOT NULL AND completed > 0)"""


@R.add("m11_official_runs", f"WITH {SQL_OFFICIAL} SELECT benchmark, run, completed, total, round(metric, 6) AS metric FROM off WHERE r = 1")
def official(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run for each benchmark: complete before partial, then by score (0 counts as none), completed samples, and name."""
    return rs.official_runs(runs(spark, sf_dir), "benchmark").select("benchmark", "run", "completed", "total", F.round("metric", 6).alias("metric"))


#: Methods of the main table: run, shown name, kind.
METHODS = (("AUTOMOBILE", "Cars", "direct"), ("BUILDING", "Houses", "direct"), ("FURNITURE", "Chairs", "retrieval"), ("HOUSEHOLD", "Homes", "retrieval"), ("MISSING", "None", "agent"))
LITERAL_ROW = ("Reported", "reported", 0.5, 0.25)


@R.add(
    "m12_main_table",
    f"""WITH {SQL_RUNS}, b AS (SELECT *, row_number() OVER (PARTITION BY benchmark, run ORDER BY round(metric, 9) DESC NULLS LAST) AS r FROM runs), m AS (SELECT * FROM (VALUES {", ".join(str(m) for m in METHODS)}) t(run, method, kind))
SELECT method, kind, round(x.metric, 6) AS first_score, CASE WHEN x.run IS NULL THEN '--' ELSE x.completed || '/' || x.total END AS first_done, round(y.metric, 6) AS second_score, CASE WHEN y.run IS NULL THEN '--' ELSE y.completed || '/' || y.total END AS second_done
FROM m LEFT JOIN b x ON x.run = m.run AND x.benchmark = 1 AND x.r = 1 LEFT JOIN b y ON y.run = m.run AND y.benchmark = 2 AND y.r = 1 UNION ALL SELECT 'Reported', 'reported', 0.5::DOUBLE, '--', 0.25::DOUBLE, '--'""",
)
def main_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed methods beside their best runs on two benchmarks, and a row as reported elsewhere."""
    return rs.main_table(runs(spark, sf_dir), METHODS, {"first": 1, "second": 2}, [LITERAL_ROW]).withColumns({c: F.round(c, 6) for c in ("first_score", "second_score")})


SQL_BUDGET = """p AS (SELECT p_partkey, 1 + p_size % 3 AS k, p_size % 2 AS budget, ['full', 'no_search', 'expansion', 'pages'][p_partkey % 4 + 1] AS mode, round(p_retailprice / 3000, 6) AS score FROM part)"""


@R.add(
    "m15_sweep_tables",
    f"""WITH {SQL_BUDGET}, t AS (SELECT 'by_k' AS part, p_partkey, k AS place FROM p WHERE mode = 'full' AND budget = 1 UNION ALL SELECT 'by_mode', p_partkey, CASE mode WHEN 'pages' THEN 0 WHEN 'expansion' THEN 1 WHEN 'full' THEN 2 ELSE 10 END FROM p WHERE k = 3),
r AS (SELECT part, p_partkey, row_number() OVER (PARTITION BY part ORDER BY place, p_partkey) AS line FROM t) SELECT part, line, p_partkey, score FROM r JOIN p USING (p_partkey)""",
)
def sweep_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of one sweep, whole: by the number of pages at a fixed budget, and by mode in a given order."""
    size = F.col("p_size")
    mode = F.get(F.array(*map(F.lit, ("full", "no_search", "expansion", "pages"))), F.col("p_partkey") % 4)
    rows = table(spark, sf_dir, "part").select("p_partkey", (1 + size % 3).alias("k"), (size % 2).alias("budget"), mode.alias("mode"), F.round(F.col("p_retailprice") / 3000, 6).alias("score"))
    by_k = rs.report(rows.where("mode = 'full' and budget = 1"), "by_k", [F.col("k"), F.col("p_partkey")])
    by_mode = rs.report(rows.where("k = 3"), "by_mode", [rs.custom_order(F.col("mode"), ("pages", "expansion", "full")), F.col("p_partkey")])
    return by_k.unionByName(by_mode).select("part", "line", "p_partkey", "score")


SQL_TRACES = """t AS (SELECT user_id, count(*) AS steps, count_if(event_type = 'purchase') AS n_decisions, count_if(event_type = 'click') AS n_open, count_if(event_type = 'view') AS n_activate, count_if(event_type = 'login') AS n_search, count(DISTINCT event_id % 5) AS opened,
  max(TRY_CAST(json_extract_string(props, '$.k') AS INT)) AS told, round(avg(value), 2) AS score FROM events GROUP BY user_id)"""


def trace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("steps"), kind("purchase").alias("n_decisions"), kind("click").alias("n_open"), kind("view").alias("n_activate"), kind("login").alias("n_search"), F.countDistinct(F.col("event_id") % 5).alias("opened"),
        F.max(F.get_json_object("props", "$.k").try_cast("int")).alias("told"), F.round(F.avg("value"), 2).alias("score"),
    )


@R.add("m16_c18_trace_rows", f"WITH {SQL_TRACES} SELECT user_id, CASE WHEN user_id % 3 = 0 THEN coalesce(told, steps) ELSE steps END::BIGINT AS steps, n_open AS opens, CASE WHEN n_open > 0 THEN n_open ELSE opened END AS opened, n_search AS searches FROM t")
def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by record: what a summary says (of every third question) before what the trace shows; id lists where no action counts."""
    rows = trace_counts(spark, sf_dir)
    steps = F.when(F.col("user_id") % 3 == 0, F.coalesce("told", "steps")).otherwise(F.col("steps")).cast("long")
    return rows.select("user_id", steps.alias("steps"), F.col("n_open").alias("opens"), F.coalesce(F.nullif(F.col("n_open"), F.lit(0)), "opened").alias("opened"), F.col("n_search").alias("searches"))


@R.add("m21_agent_diagnostics", f"WITH {SQL_TRACES} SELECT user_id, n_decisions, n_open, n_activate, n_search, steps, opened FROM t")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_counts(spark, sf_dir).select("user_id", "n_decisions", "n_open", "n_activate", "n_search", "steps", "opened")


@R.add("m21_iteration_rows", """WITH s AS (SELECT user_id, event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT user_id, event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN k END, n)::BIGINT AS iteration, event_type AS decision, (event_id % 4)::BIGINT AS retrieved FROM s""")
def iteration_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each step of a trace; a step without its own number has its place."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    own = F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k").try_cast("int"))
    return table(spark, sf_dir, "events").withColumn("n", place).select("user_id", "event_id", F.coalesce(own, "n").cast("long").alias("iteration"), F.col("event_type").alias("decision"), (F.col("event_id") % 4).alias("retrieved"))


SQL_RICHNESS = f"""{SQL_TRACES}, k AS (SELECT *, user_id % 10 AS run, CASE WHEN score >= 50 THEN 'success' ELSE 'failure' END AS kind, 5 * n_decisions + 3 * n_open + n_activate + 4 * n_search + opened AS richness FROM t)"""


@R.add("m20_case_selection", f"WITH {SQL_RICHNESS}, r AS (SELECT *, row_number() OVER (PARTITION BY run, kind ORDER BY (user_id % 2 = 0)::INT DESC, richness DESC, opened DESC, n_search DESC, steps DESC, user_id DESC) AS r FROM k WHERE richness > 0) SELECT run, kind, user_id, richness FROM r WHERE r = 1")
def case_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each run its richest success and its richest failure."""
    rows = trace_counts(spark, sf_dir).withColumns({"run": F.col("user_id") % 10, "kind": F.when(F.col("score") >= 50, "success").otherwise("failure"), "answerable": (F.col("user_id") % 2 == 0).cast("int")})
    return rs.case_selection(rows, ["run", "kind"], "user_id").select("run", "kind", "user_id", "richness")


SQL_NESTED = f"""{SQL_RUNS}, j AS (SELECT benchmark || '-' || run AS id, total, completed, coalesce(metric, 0) AS metric FROM runs)"""


@R.add(
    "m28_flat_metrics",
    f"""WITH {SQL_NESTED} SELECT id, 'overall' AS path, 'overall' AS category, 'overall' AS name, round(metric, 6) AS value, total AS n FROM j UNION ALL SELECT id, 'pages.single.acc', 'pages', 'acc', round(metric / 2, 6), completed FROM j
UNION ALL SELECT id, 'pages.share', 'pages', 'share', completed::DOUBLE, total FROM j UNION ALL SELECT id, 'pages.single.deep.f1', 'pages', 'f1', 0.5::DOUBLE, completed FROM j""",
)
def flat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested metrics of each run as rows: numbers by their path, with the count of the nearest level that has one."""
    m, text = F.coalesce("metric", F.lit(0.0)), lambda c: F.col(c).cast("string")
    js = F.concat(
        F.lit('{"overall":'), m.cast("string"), F.lit(',"name":"x","count":'), text("total"), F.lit(',"pages":{"share":'), text("completed"), F.lit(',"single":{"count":'), text("completed"), F.lit(',"acc":'), (m / 2).cast("string"), F.lit(',"deep":{"f1":0.5}}}}')
    )
    rows = runs(spark, sf_dir).select(F.concat_ws("-", F.col("benchmark").cast("string"), "run").alias("id"), js.alias("metrics"))
    return op.flat_metrics(rows, "id", "metrics").withColumn("value", F.round("value", 6))


@R.add("m35_balanced_bins", """WITH o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS p FROM documents)
SELECT CASE WHEN (p // 8) % 2 = 0 THEN p % 8 ELSE 7 - p % 8 END::INT AS bin, count(*) AS n, sum(n_chars)::BIGINT AS size FROM o GROUP BY 1""")
def balanced_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight bins of about equal size."""
    dealt = op.balanced(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 8)
    return dealt.groupBy("bin").agg(F.count("*").alias("n"), F.sum("n_chars").alias("size"))
