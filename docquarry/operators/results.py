"""The result store: resume, dedup, leaderboards, comparisons, audits."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.sources.scratch import keep


def compact(records: DataFrame, key: str, line: str, good: Column) -> DataFrame:
    """Successful records only; of a key the last one, in the place of its first."""
    w = Window.partitionBy(key)
    kept = records.where(good).withColumns({"first_line": F.min(line).over(w), "r": F.row_number().over(w.orderBy(F.col(line).desc()))})
    return kept.where("r = 1").drop("r")


def merge(samples: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Samples with their results; a result's field stands where it isn't null."""
    shared = [c for c in results.columns if c != key and c in samples.columns]
    r = results.select(F.col(key).alias("r_key"), *[F.col(c).alias(f"r_{c}") if c in shared else F.col(c) for c in results.columns if c != key])
    out = samples.join(r, F.col(key) == F.col("r_key"), "left")
    return out.select(*[F.coalesce(f"r_{c}", c).alias(c) if c in shared else F.col(c) for c in samples.columns], *[c for c in results.columns if c != key and c not in shared])


def pending(samples: DataFrame, results: DataFrame, key: str) -> DataFrame:
    return samples.join(results.select(F.col(key).alias("done")), F.col(key) == F.col("done"), "left_anti")


def pairwise(a: DataFrame, b: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """Scores of two runs on the same questions, the last record of each: difference and outcome."""
    last = lambda x, n: x.groupBy(F.col(key).alias(f"key_{n}")).agg(F.max_by(score, order).alias(f"score_{n}"))
    both = last(a, "a").join(last(b, "b"), F.col("key_a") == F.col("key_b"))
    d = F.col("score_a") - F.col("score_b")
    return both.select(F.col("key_a").alias(key), "score_a", "score_b", d.alias("delta"), F.when(d > 1e-9, "win").when(d < -1e-9, "loss").otherwise("tie").alias("outcome"))


def outcome_counts(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by).agg(F.count_if(F.col("outcome") == "win").alias("wins"), F.count_if(F.col("outcome") == "loss").alias("losses"), F.count_if(F.col("outcome") == "tie").alias("ties"), F.count("*").alias("aligned"))


def best_runs(runs: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The best run of each group."""
    return runs.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("r = 1").drop("r")


def audit(runs: DataFrame) -> DataFrame:
    """Status of each run, first match: missing_metrics, empty, partial, invalid_schema, complete; and its warnings."""
    status = (
        F.when(F.col("metric").isNull(), "missing_metrics").when(F.col("completed") == 0, "empty").when(F.col("completed") < F.col("total"), "partial").when(~F.col("valid"), "invalid_schema").otherwise("complete")
    )
    notes = F.array(F.when(F.col("metric").isNull(), F.lit("no metrics")), F.when(F.col("completed") < F.col("total"), F.lit("not all samples done")), F.when(~F.col("valid"), F.lit("schema")))
    return runs.withColumns({"status": status, "warnings": F.array_distinct(F.filter(notes, lambda x: x.isNotNull()))})


def highlights(rows: DataFrame, name: str, metrics: list[str]) -> DataFrame:
    """Best and second-best distinct values of each metric column."""
    long = rows.unpivot([name], metrics, "metric", "value").where("value is not null")
    placed = long.withColumn("place", F.dense_rank().over(Window.partitionBy("metric").orderBy(F.col("value").desc())))
    return placed.where("place <= 2")


def breakdown(rows: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Wide to long, nulls dropped, in per cent."""
    return rows.unpivot(ids, columns, "category", "value").where("value is not null").withColumn("value", F.col("value") * 100)


def numbered(rows: DataFrame, order: str | list[Column], name: str) -> DataFrame:
    """Consecutive numbers from 1 in the order of a column, or of several: places within range partitions, after the sizes of those before.

    A window over all rows would put them in one task. The partitions are written once with their number and the
    places of their rows, so that sizes and places belong to the same cut; the driver gets one size per partition.
    """
    part, place = f"part_{name}", f"place_{name}"
    by = [F.col(order)] if isinstance(order, str) else order
    parts = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    parts = keep(parts.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1}), "numbered")
    sizes = sorted((r[part], r["count"]) for r in parts.groupBy(part).count().collect())
    before = list(accumulate((n for _, n in sizes), initial=0))
    starts = rows.sparkSession.createDataFrame([(p, n) for (p, _), n in zip(sizes, before, strict=False)], f"of_{name} int, before_{name} bigint")
    joined = parts.join(F.broadcast(starts), F.col(part) == F.col(f"of_{name}"))  # a row a partition
    return joined.withColumn(name, F.col(f"before_{name}") + F.col(place)).select(*rows.columns, name)


def allocate_ids(rows: DataFrame, order: str, name: str, prefix: str, width: int) -> DataFrame:
    """Ids of prefix and padded number for rows without one, in order, skipping those in use.

    Among n rows at most n numbers are in use, so the first n numbers hold enough free ones.
    """
    have, lack = rows.where(F.col(name).isNotNull()), rows.where(F.col(name).isNull())
    total = rows.count()
    free = rows.sparkSession.range(total).select(F.col("id").alias("number"), F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), width, "0")).alias("free_id"))
    free = free.join(have.select(F.col(name).alias("used")), F.col("free_id") == F.col("used"), "left_anti")
    given = numbered(lack.drop(name), order, "place").join(numbered(free, "number", "slot"), F.col("place") == F.col("slot"))
    return have.unionByName(given.select(*[F.col("free_id").alias(name) if c == name else F.col(c) for c in rows.columns]))


def sweep(rows: DataFrame, by: str, parameters: dict[str, Column]) -> DataFrame:
    """Every combination of the distinct values that the rows of an experiment list for each parameter."""
    lists = rows.groupBy(by).agg(*[F.collect_set(v).alias(k) for k, v in parameters.items()])
    for k in parameters:
        lists = lists.withColumn(k, F.explode(k))
    return lists


def official_runs(runs: DataFrame, by: str) -> DataFrame:
    """The run to report for each group of ``runs(by, run, total, completed, metric)``: complete before partial, then by score, where 0
    counts as no score, by completed samples, and by name."""
    score = F.when(F.col("metric") == 0, -1.0).otherwise(F.round("metric", 9))
    order = [(F.col("completed") == F.col("total")).cast("int").desc(), score.desc(), F.col("completed").desc(), F.col("run").desc()]
    return best_runs(runs.where("metric is not null and completed > 0"), [by], order)


def main_table(runs: DataFrame, methods: tuple[tuple[str, str, str], ...], benchmarks: dict[str, object], literal: list[tuple]) -> DataFrame:
    """A row for each of the few named methods (run, shown name, kind), beside its best run on each benchmark, and literal rows."""
    spark = runs.sparkSession
    out = spark.createDataFrame(list(methods), "run string, method string, kind string")
    best = best_runs(runs, ["benchmark", "run"], [F.round("metric", 9).desc_nulls_last()])
    for name, value in benchmarks.items():
        own = best.where(F.col("benchmark") == value).select(F.col("run").alias(f"{name}_run"), F.col("metric").alias(f"{name}_score"), F.concat_ws("/", "completed", "total").alias(f"{name}_done"))
        out = out.join(own, F.col("run") == F.col(f"{name}_run"), "left").drop(f"{name}_run").withColumn(f"{name}_done", F.coalesce(f"{name}_done", F.lit("--")))
    shape = "method string, kind string, " + ", ".join(f"{name}_score double" for name in benchmarks)
    said = spark.createDataFrame(literal, shape).withColumns({f"{name}_done": F.lit("--") for name in benchmarks})
    return out.drop("run").unionByName(said)


def custom_order(value: Column, first: tuple[str, ...], rest: int = 10) -> Column:
    """The place of a value in a given order; ``rest`` for others."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, v in enumerate(first) for x in (v, i)]), value), F.lit(rest))


def report(rows: DataFrame, name: str, order: list[Column], limit: int | None = None) -> DataFrame:
    """The lines of a table in an order, numbered from 1: all of them by range partitions, or the first ``limit``, to which Spark cuts
    each task's rows before it shuffles."""
    if limit is None:
        return numbered(rows, order, "line").withColumn("part", F.lit(name)).select(*rows.columns, "part", "line")
    return rows.withColumns({"part": F.lit(name), "line": F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order))}).where(F.col("line") <= limit)


def case_selection(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """The richest case of each group: decisions count five, opened nodes' actions three, activations one, searches four, and each opened
    node one. Answerable questions come first; ties go by opened nodes, searches, steps and the key."""
    rich = rows.withColumn("richness", 5 * F.col("n_decisions") + 3 * F.col("n_open") + F.col("n_activate") + 4 * F.col("n_search") + F.col("opened")).where("richness > 0")
    return best_runs(rich, by, [F.col(c).desc() for c in ("answerable", "richness", "opened", "n_search", "steps", key)])
