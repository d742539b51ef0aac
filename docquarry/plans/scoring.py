"""Queries of answer scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import scoring as fn
from docquarry.functions import text as tx
from docquarry.plans.common import Registry, sql_tokens, table

R = Registry()


def sql_anls(g: str, p: str) -> str:
    s = f"CASE WHEN greatest(length({g}), length({p})) = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein({g}, {p})::DOUBLE / greatest(length({g}), length({p})) END"
    return f"CASE WHEN {s} <= 0.5 THEN 0.0::DOUBLE ELSE {s} END"


@R.add("a01_a02_anls", f"SELECT p_partkey, levenshtein(p_name, p_type)::INT AS distance, round({sql_anls('p_name', 'p_type')}, 6) AS anls FROM part")
def anls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"), F.round(fn.anls(F.col("p_name"), F.col("p_type")), 6).alias("anls"))


#: Pairs of numbers as answers: prices as gold, prices off by some per cent or a hundredfold as predictions.
SQL_NUMBERS = """n AS (SELECT p_partkey, p_retailprice AS g, CASE p_size % 4 WHEN 0 THEN p_retailprice * 1.005 WHEN 1 THEN p_retailprice / 100 WHEN 2 THEN p_retailprice * 1.02 ELSE p_retailprice * 100 END AS p FROM part)"""


@R.add(
    "a03_a08_float_scores",
    f"""WITH {SQL_NUMBERS}, c AS (SELECT p_partkey, g, p, unnest([g / 100, g, g * 100]) AS x FROM n)
SELECT p_partkey, max(CASE WHEN abs(x - p) <= 0.01 * greatest(abs(x), abs(p)) THEN 1.0::DOUBLE ELSE 0 END) AS score FROM c GROUP BY p_partkey""",
)
def float_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, k = F.col("p_retailprice"), F.col("p_size") % 4
    p = F.when(k == 0, g * 1.005).when(k == 1, g / 100).when(k == 2, g * 1.02).otherwise(g * 100)
    rows = table(spark, sf_dir, "part").select("p_partkey", g.cast("string").alias("g"), p.cast("string").alias("p"))
    return rows.select("p_partkey", fn.score_m(F.col("g"), F.col("p"), F.lit("Float")).alias("score"))


@R.add(
    "a04_a05_answer_forms",
    r"""SELECT page_id, contains(url, 'https://') OR regexp_matches(url, '(\.py|ipynb)$') OR starts_with(url, 'page') OR regexp_full_match(url, '\d+(-\d+|\s\d+)?') OR regexp_matches(url, '[ap]\.m\.') AS url_exact,
regexp_full_match(page_id::VARCHAR, '\d+(-\d+|\s\d+)?') AS id_exact, TRY_CAST(page_id::VARCHAR AS DOUBLE) IS NOT NULL AS id_float FROM pages""",
)
def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select("page_id", fn.exact_match_form(F.col("url")).alias("url_exact"), fn.exact_match_form(number).alias("id_exact"), fn.float_like(number).alias("id_float"))


def _sql_suffix(s: str, suffixes: tuple[str, ...]) -> str:
    """A chain of CTEs that strip one suffix each."""
    steps, name = [], s
    for i, suffix in enumerate(suffixes):
        steps.append(f"s{i} AS (SELECT key, CASE WHEN ends_with(t, '{suffix}') THEN trim(left(t, length(t) - {len(suffix)})) ELSE t END AS t FROM {name})")
        name = f"s{i}"
    return ", ".join(steps) + f", bare AS (SELECT key, trim(rtrim(trim(ltrim(trim(regexp_replace(trim(regexp_replace(t, '\\s*\\([^)]*\\)', '', 'g')), '^[''\"]|[''\"]$', '', 'g')), '$')), '%')) AS t FROM {name})"


@R.add("a06_clean_m", f"WITH src AS (SELECT p_partkey AS key, trim(lower(p_type || ' (' || p_size || ') million')) AS t FROM part), {_sql_suffix('src', fn.SUFFIXES_M)} SELECT key AS p_partkey, t AS cleaned FROM bare")
def clean_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat("p_type", F.lit(" ("), F.col("p_size").cast("string"), F.lit(") million"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.clean_m(answer).alias("cleaned"))


@R.add("a07_clean_l", f"WITH src AS (SELECT c_custkey AS key, replace(trim(lower(c_name || ', $' || c_acctbal || '% kg')), ',', '') AS t FROM customer), {_sql_suffix('src', fn.SUFFIXES_L)} SELECT key AS c_custkey, trim(ltrim(t, '£')) AS cleaned FROM bare")
def clean_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat("c_name", F.lit(", $"), F.col("c_acctbal").cast("string"), F.lit("% kg"))
    return table(spark, sf_dir, "customer").select("c_custkey", fn.clean_l(answer).alias("cleaned"))


SQL_LISTS = "l AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS g, string_split(lower(p_type), ' ') AS p FROM part)"


@R.add(
    "a08_a09_list_scores",
    f"""WITH {SQL_LISTS}, x AS (SELECT p_partkey, len(g) AS ng, len(p) AS np, unnest(g) AS gi, p FROM l), y AS (SELECT p_partkey, ng, np, gi, unnest(p) AS pi FROM x),
b AS (SELECT p_partkey, ng, np, gi, max({sql_anls('gi', 'pi')}) AS best FROM y GROUP BY ALL),
c AS (SELECT p_partkey, max(ng) AS ng, max(np) AS np, sum(best * k) AS total FROM b JOIN (SELECT p_partkey, gi, count(*) AS k FROM x GROUP BY ALL) USING (p_partkey, gi) GROUP BY p_partkey)
SELECT p_partkey, round(total / ng * sqrt(least(1.0::DOUBLE, ng / np)), 6) AS score FROM c""",
)
def list_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("g"), F.split(F.lower("p_type"), " ").alias("p"))
    return rows.select("p_partkey", F.round(fn.list_score_l(F.col("g"), F.col("p")), 6).alias("score"))


@R.add(
    "a18_set_f1",
    """WITH t AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(p_name), '[!-/:-@\\[-`{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS g,
  list_distinct(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(p_type), '[!-/:-@\\[-`{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS p FROM part)
SELECT p_partkey, round(CASE WHEN len(list_intersect(g, p)) = 0 THEN 0.0::DOUBLE ELSE 2 * len(list_intersect(g, p)) / (len(g) + len(p)) END, 6) AS f1 FROM t""",
)
def set_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(fn.set_f1(F.col("p_name"), F.col("p_type")), 6).alias("f1"))


@R.add(
    "a19_a20_rewards",
    """WITH c AS (SELECT conv_id, turn, '<think>' || role || '</think> Answer: ' || text AS r, length(text) AS n FROM conversations)
SELECT conv_id, turn, trim(regexp_extract(r, '(?s)<think>(.*?)</think>', 1)) AS think, trim(regexp_extract(r, '(?is)^.*\\banswer\\s*:\\s*([^\\n]*)', 1)) AS answer,
round(CASE WHEN n <= 200 THEN 0.0::DOUBLE WHEN n >= 800 THEN -1 ELSE (200 - n) / 600.0::DOUBLE END, 6) AS penalty FROM c""",
)
def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.concat(F.lit("<think>"), "role", F.lit("</think> Answer: "), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.tagged(r, "think").alias("think"), fn.last_answer(r).alias("answer"), F.round(fn.length_penalty(F.length("text"), 200, 800), 6).alias("penalty"))


SQL_SCORES = "s AS (SELECT event_id, user_id, event_type, value, least(1.0::DOUBLE, round(abs(value) / 50, 1)) AS score, CASE WHEN event_id % 3 = 0 THEN least(1.0::DOUBLE, round(abs(value) / 40, 1)) END AS corrected FROM events)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored answers: value as score; every third has been corrected."""
    score = lambda by: F.least(F.lit(1.0), F.round(F.abs("value") / by, 1))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", score(50).alias("score"), F.when(F.col("event_id") % 3 == 0, score(40)).alias("corrected"))


@R.add(
    "a13_a14_a23_a24_corrections",
    f"""WITH {SQL_SCORES} SELECT event_id, coalesce(corrected, score) AS shown, CASE WHEN score >= 0.999 THEN 'correct' WHEN score <= 0.001 THEN 'wrong' ELSE 'partial' END AS bucket,
CASE WHEN corrected IS NULL THEN 'not_run' WHEN score >= 0.999 THEN 'skipped_initial_correct' WHEN score <= 0.001 AND corrected >= 0.999 THEN 'wrong_to_correct' WHEN score <= 0.001 AND corrected <= 0.001 THEN 'wrong_to_wrong'
  WHEN corrected > score AND corrected < 0.999 THEN 'improved_partial' WHEN corrected < score THEN 'regressed' ELSE 'unchanged' END AS outcome FROM s""",
)
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, none = scores(spark, sf_dir), F.lit(None).cast("string")
    score, corrected = F.col("score"), F.col("corrected")
    return rows.select(
        "event_id",
        fn.display_score(corrected.cast("string"), none, score.cast("string")).alias("shown"),
        fn.score_bucket(score).alias("bucket"),
        fn.correction_outcome(corrected.isNotNull(), none, score, corrected, corrected).alias("outcome"),
    )


@R.add(
    "c17_crop_boxes",
    """WITH b AS (SELECT p_partkey, (p_size * 13) % 900 AS x0, (p_size * 7) % 900 AS y0, (p_size * 13) % 900 + p_size * 2 AS x1, (p_size * 7) % 900 + p_size AS y1 FROM part),
r AS (SELECT p_partkey, round_even(x0 / 1000.0::DOUBLE * 800, 0)::INT AS l, round_even(y0 / 1000.0::DOUBLE * 1100, 0)::INT AS t, round_even(x1 / 1000.0::DOUBLE * 800, 0)::INT AS r, round_even(y1 / 1000.0::DOUBLE * 1100, 0)::INT AS b FROM b),
p AS (SELECT p_partkey, l, t, r, b, greatest(8, floor((r - l) * 0.06::DOUBLE)::INT) AS px, greatest(8, floor((b - t) * 0.06::DOUBLE)::INT) AS py FROM r),
c AS (SELECT p_partkey, r > l AND b > t AS ok, greatest(0, l - px) AS l, greatest(0, t - py) AS t, least(800, r + px) AS r, least(1100, b + py) AS b FROM p)
SELECT p_partkey, CASE WHEN ok AND r - l >= 20 AND b - t >= 20 THEN concat_ws(',', l, t, r, b) ELSE '' END AS box FROM c""",
)
def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    x0, y0 = (s * 13) % 900, (s * 7) % 900
    box = fn.crop_box(x0, y0, x0 + s * 2, y0 + s, F.lit(800), F.lit(1100))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.array_join(F.transform(box, lambda v: v.cast("string")), ","), F.lit("")).alias("box"))


@R.add("p02_page_numbers", "SELECT p_partkey, concat_ws(',', p_size, p_size + 1) AS numbers FROM part")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of image names, repeats and names without one left out."""
    size = F.col("p_size")
    names = F.array(*[F.concat(F.lit("x/d_"), (size + i).cast("string"), F.lit(ext)) for i, ext in ((0, ".png"), (1, ".jpg"), (0, ".png"))], F.lit("cover.png"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(tx.page_numbers(names), lambda n: n.cast("string")), ",").alias("numbers"))


@R.add("t10_token_counts", f"SELECT doc_id, len({sql_tokens('text')})::INT AS n_tokens, len(list_distinct({sql_tokens('text')}))::INT AS n_distinct FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tx.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.size(F.array_distinct(tokens)).alias("n_distinct"))
