"""Queries of answers as lists and literals, and of dataset rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import literals as fn
from docquarry.plans.common import Registry, spread, table

R = Registry()


@R.add(
    "a11_literal_items",
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_name || '|' || p_size WHEN 1 THEN p_name || '|' || p_size WHEN 2 THEN p_name || '-' || p_size || '|x-1' WHEN 3 THEN '[' || p_name || ', ' || p_size ELSE '' END AS items FROM part""",
)
def literal_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written as a list, a tuple, a list of mappings, a broken list, and nothing."""
    q = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    n, k = F.col("p_size").cast("string"), F.col("p_size") % 5
    text = (
        F.when(k == 0, F.concat(F.lit(" ["), q("p_name"), F.lit(", "), n, F.lit("] ")))
        .when(k == 1, F.concat(F.lit("("), q("p_name"), F.lit(", '"), n, F.lit("')")))
        .when(k == 2, F.concat(F.lit("[{'a': "), q("p_name"), F.lit(", 'b': "), n, F.lit("}, {'a': 'x', 'b': 1}]")))
        .when(k == 3, F.concat(F.lit("["), F.col("p_name"), F.lit(", "), n))
        .otherwise("")
    )
    return spread(table(spark, sf_dir, "part")).select("p_partkey", F.array_join(fn.literal_items(text), "|").alias("items"))


@R.add(
    "a15_normalized_spans",
    """SELECT p_partkey, array_to_string(list_filter(string_split(regexp_replace(replace(lower(p_name), '-', ' '), '[!-/:-@\\[-`{-~]', '', 'g'), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')
  || ' ' || p_size || '.0 inch ' || ['0.0', '1.0', '12.0', '20.0', '100.0'][p_size % 5 + 1] || ' ' || (p_retailprice::DOUBLE)::VARCHAR AS span FROM part""",
)
def normalized_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with an article, numbers in digits and in words, and hyphens."""
    word = F.get(F.array(*map(F.lit, ("Zero", "one", "Twelve!", "TWENTY", "hundred"))), F.col("p_size") % 5)
    text = F.concat(F.lit("The "), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("-inch, "), word, F.lit(" "), F.col("p_retailprice").cast("string"))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", fn.normalized(text).alias("span"))


#: Two gold spans against two or one predicted ones, so that the best assignment is one of two.
SQL_BAGS = """l AS (SELECT p_partkey, p_size % 3 = 0 AS short, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b,
  list_distinct(string_split(lower(p_type || ' ' || p_brand), ' ')) AS c, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS d FROM (SELECT p_partkey, p_size, regexp_replace(p_name, '[!-/:-@\\[-`{-~]', '', 'g') AS p_name, regexp_replace(p_type, '[!-/:-@\\[-`{-~]', '', 'g') AS p_type, regexp_replace(p_brand, '[!-/:-@\\[-`{-~]', '', 'g') AS p_brand FROM part))"""
SQL_F1 = lambda g, p: f"(2.0::DOUBLE * len(list_intersect({g}, {p})) / (len({g}) + len({p})))"


@R.add(
    "a16_list_scores",
    f"""WITH {SQL_BAGS}, f AS (SELECT p_partkey, short, {SQL_F1('a', 'c')} AS ac, {SQL_F1('a', 'd')} AS ad, {SQL_F1('b', 'c')} AS bc, {SQL_F1('b', 'd')} AS bd FROM l)
SELECT p_partkey, round_even(CASE WHEN short THEN greatest(ac, bc) / 2 ELSE greatest(ac + bd, ad + bc) / 2 END, 2) AS f1, CASE WHEN p_partkey % 4 = 0 THEN 1.0::DOUBLE ELSE 0 END AS em FROM f""",
)
def list_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "part"))
    gold = F.array("p_name", "p_type")
    pred = F.when(F.col("p_size") % 3 == 0, F.array(F.concat_ws(" ", "p_type", "p_brand"))).otherwise(F.array(F.concat_ws(" ", "p_type", "p_brand"), F.concat_ws(" ", "p_name", "p_type")))
    same = F.when(F.col("p_partkey") % 4 == 0, F.array(F.upper("p_type"), F.concat(F.lit("the "), "p_name"))).otherwise(F.array(F.lit("other"), F.col("p_name")))
    return rows.select("p_partkey", fn.list_f1_score(gold, pred).alias("f1"), fn.list_em_score(gold, same).alias("em"))


@R.add(
    "a22_dataset_checks",
    """WITH c AS (SELECT p_partkey, p_size % 4 AS k, p_retailprice AS g, lower(p_name) AS n FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN abs(round(g * (0.9::DOUBLE + 0.02::DOUBLE * (p_partkey % 10)), 2) - g) / g <= 0.05::DOUBLE WHEN 1 THEN true WHEN 2 THEN p_partkey % 2 = 0 ELSE p_partkey % 3 = 0 END AS correct FROM c""",
)
def dataset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers a few per cent off, texts with marks and a per cent sign, choices, and any of several golds."""
    key, k, text = F.col("p_partkey"), F.col("p_size") % 4, lambda c: c.cast("string")
    kind = F.when(k == 0, "number").when(k == 2, "choice").otherwise("text")
    off = F.round(F.col("p_retailprice") * (0.9 + 0.02 * (key % 10)), 2)
    answer = F.when(k == 0, F.concat(text(off), F.lit("%"))).when(k == 1, F.concat(F.lit("The "), F.upper("p_name"), F.lit(" !\n"))).when(k == 2, F.when(key % 2 == 0, "b) yes").otherwise("c")).otherwise(F.when(key % 3 == 0, "Three").otherwise("four"))
    golds = F.when(k == 0, F.array(text(F.col("p_retailprice")))).when(k == 1, F.array(F.col("p_name"))).when(k == 2, F.array(F.lit("B"))).otherwise(F.array(F.lit("7"), F.lit("3")))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", fn.vqa_correct(kind, answer, golds).alias("correct"))


@R.add("c21_mended_json", """SELECT p_partkey, '{"id":"n' || p_partkey || '","task":"find \\"' || p_name || '\\" in' || CASE WHEN p_size % 2 = 0 THEN '\\n' ELSE ' ' END || 'it","children":["a","b"]}' AS json FROM part""")
def mended_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with words around the object, quotes and line breaks inside strings, and commas too many."""
    body = F.concat(F.lit('{"id": "n'), F.col("p_partkey").cast("string"), F.lit('", "task": "find "'), "p_name", F.lit('" in'), F.when(F.col("p_size") % 2 == 0, "\n").otherwise(" "), F.lit('it", "children": ["a", "b",],}'))
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Here: <dag>```json\n"), body, F.lit("\n```</dag> done"))).otherwise(F.concat(F.lit("x "), body))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", fn.repaired_json(text).alias("json"))
