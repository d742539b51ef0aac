"""Metrics over scored answers, rankings, traces and rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.results import numbered
from docquarry.sources.scratch import keep


def acc_and_f1(rows: DataFrame, by: list[str] | None = None, score: str = "score", gold: str = "answerable", pred: str = "pred_answerable") -> DataFrame:
    """acc: the mean score. Recall: scores of the answerable over their number; precision: the same sum over the
    number of those predicted answerable. Zero denominators give 0."""
    right = F.sum(F.when(F.col(gold), F.col(score)).otherwise(0.0))
    sums = rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(score).alias("acc"), F.try_divide(right, F.sum(F.col(gold).cast("double"))).alias("recall"), F.try_divide(right, F.sum(F.col(pred).cast("double"))).alias("precision")
    )
    r, p = F.coalesce("recall", F.lit(0.0)), F.coalesce("precision", F.lit(0.0))
    return sums.select(*(by or []), "n", F.coalesce("acc", F.lit(0.0)).alias("acc"), r.alias("recall"), p.alias("precision"), F.coalesce(F.try_divide(2 * r * p, r + p), F.lit(0.0)).alias("f1"))


def group_advantages(rows: DataFrame, by: str, value: str, eps: float = 1e-6) -> DataFrame:
    """Z-score by the sample deviation, leave-one-out difference, difference to the mean; groups of one go."""
    w = Window.partitionBy(by)
    x, n, s = F.col(value), F.count("*").over(w), F.sum(value).over(w)
    full = rows.withColumns({"n": n, "total": s, "spread": F.stddev_samp(value).over(w)}).where("n > 1")
    mean = F.col("total") / F.col("n")
    return full.withColumns({"z": (x - mean) / (F.col("spread") + eps), "loo": x - (F.col("total") - x) / (F.col("n") - 1), "centred": x - mean}).drop("n", "total", "spread")


def first_hits(run: DataFrame, qrels: DataFrame, q: str, d: str, order: list[Column], k: int) -> DataFrame:
    """``(q, d, rank, rel)``: the run's first ``k`` with the relevance of each (0 without a judgement).

    Spark cuts each task's rows to k a query before they are shuffled, so a query of very many rows is no load.
    """
    ranked = run.withColumn("rank", F.row_number().over(Window.partitionBy(q).orderBy(*order))).where(F.col("rank") <= k)
    judged = qrels.select(F.col(q).alias("jq"), F.col(d).alias("jd"), "rel")
    return ranked.join(judged, (F.col(q) == F.col("jq")) & (F.col(d) == F.col("jd")), "left").select(q, d, "rank", F.coalesce("rel", F.lit(0)).alias("rel"))


def ir_metrics(hits: DataFrame, qrels: DataFrame, q: str, k: int) -> DataFrame:
    """Per query of the run: reciprocal rank, nDCG and recall at ``k``."""
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    top = hits.groupBy(q).agg(
        F.coalesce(F.max(F.when((F.col("rel") > 0) & (F.col("rank") <= k), 1 / F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("dcg"),
        F.sum(F.when((F.col("rank") <= k) & (F.col("rel") > 0), 1).otherwise(0)).alias("found"),
    )
    best = qrels.where("rel > 0").withColumn("i", F.row_number().over(Window.partitionBy(q).orderBy(F.col("rel").desc()))).where(F.col("i") <= k)
    ideal = best.groupBy(F.col(q).alias("iq")).agg(F.sum(F.col("rel") / F.log2(F.col("i") + 1)).alias("idcg"))
    ideal = ideal.join(qrels.where("rel > 0").groupBy(F.col(q).alias("rq")).agg(F.count("*").alias("relevant")), F.col("iq") == F.col("rq"))
    return top.join(ideal, F.col(q) == F.col("iq"), "left").select(
        q, "rr", F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)).alias("ndcg"), F.coalesce(F.try_divide("found", "relevant"), F.lit(0.0)).alias("recall")
    )


def overlapping_groups(rows: DataFrame, group: Column, values: dict[str, Column], names: list[str]) -> DataFrame:
    """The same aggregates over all rows and over each named group; groups without rows are there with nulls."""
    labelled = rows.withColumn("grp", group)
    both = labelled.select("*", F.explode(F.array(F.lit("overall"), F.col("grp"))).alias("part"))
    sums = both.groupBy("part").agg(*[v.alias(k) for k, v in values.items()])
    every = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ["overall", *names]))).alias("name"))
    return every.join(sums, F.col("name") == F.col("part"), "left").drop("part").withColumnRenamed("name", "part")


def balanced(rows: DataFrame, size: str, key: str, bins: int) -> DataFrame:
    """A bin for each row, in descending size back and forth over the bins."""
    ordered = numbered(rows.withColumn("order", F.struct((-F.col(size)).alias("size"), F.col(key).alias("key"))), "order", "place")
    place = F.col("place") - 1
    lap, at = F.floor(place / bins), place % bins
    return ordered.withColumn("bin", F.when(lap % 2 == 0, at).otherwise(bins - 1 - at).cast("int")).select(*rows.columns, "bin")


def flat_metrics(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, path, category, name, value, n)`` of the numbers in nested JSON objects; n is the "count" of the nearest level that has one.

    One pass a level of nesting: objects inside objects go on to the next.
    """
    level = rows.select(key, F.lit("").alias("path"), F.col(text).alias("body"), F.lit(None).cast("bigint").alias("n"))
    found = None
    while True:
        parsed = level.withColumn("fields", F.from_json("body", "map<string,string>")).withColumn("n", F.coalesce(F.try_element_at("fields", F.lit("count")).try_cast("bigint"), "n"))
        fields = parsed.select(key, "path", "n", F.explode("fields").alias("name", "value"))
        path = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws(".", "path", "name"))
        fields = keep(fields.select(key, path.alias("path"), "name", "value", "n"), "metrics")
        number = F.col("value").try_cast("double")
        leaves = fields.where((F.col("name") != "count") & number.isNotNull()).select(key, "path", F.substring_index("path", ".", 1).alias("category"), "name", number.alias("value"), "n")
        found = leaves if found is None else found.unionByName(leaves)
        level = fields.where(F.startswith("value", F.lit("{"))).select(key, "path", F.col("value").alias("body"), "n")
        if level.isEmpty():
            return found
