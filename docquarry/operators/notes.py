"""Notes of a memory: links from each to its nearest earlier ones, and memories saved and loaded as tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.operators.results import numbered
from docquarry.operators.retrieval import top_k


def earlier_links(notes: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """``(note_id, earlier, rank, score)``: the ``k`` notes before each of ``notes(note_id, vec)`` that are nearest by cosine.

    Notes are cut into blocks by their place in the order of ids; a block meets itself and those before it (the
    triangle of block pairs), each pair in a task that holds two blocks and from which k links a note leave. Zero vectors link with nothing.
    """
    placed = numbered(notes.select("note_id", "vec"), "note_id", "place").withColumn("b", F.floor((F.col("place") - 1) / block).cast("int"))
    last = placed.agg(F.max("b")).first()[0] or 0
    late = placed.select("b", F.explode(F.sequence(F.lit(0), F.col("b"))).alias("e"), "note_id", "place", "vec")
    early = placed.select(F.explode(F.sequence(F.col("b"), F.lit(last))).alias("late_b"), F.col("b").alias("early_b"), F.col("note_id").alias("early_id"), F.col("place").alias("early_place"), F.col("vec").alias("early_vec"))

    def units(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = rows.column(rows.num_columns - 1).combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
        size = np.linalg.norm(x, axis=1)
        return x / np.maximum(size, 1e-300)[:, None], size > 0

    def run(late: pa.Table, early: pa.Table) -> pa.Table:
        names = ["note_id", "earlier", "score"]
        if not (late.num_rows and early.num_rows):
            return pa.table([late["note_id"].slice(0, 0), early["early_id"].slice(0, 0), pa.array([], pa.float64())], names=names)
        early = early.sort_by("early_place")
        (x, some), (y, other) = units(late), units(early)
        at, before = late["place"].to_numpy(), early["early_place"].to_numpy()
        out = []
        for a in range(0, len(x), 1024):
            score = np.round(x[a : a + 1024] @ y.T, 9)
            score[(before[None, :] >= at[a : a + 1024, None]) | ~some[a : a + 1024, None] | ~other[None, :]] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            i, j = np.repeat(np.arange(len(score)), best.shape[1]), best.ravel()
            held = np.isfinite(score[i, j])
            out.append((i[held] + a, j[held], score[i[held], j[held]]))
        i, j, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table([late["note_id"].take(pa.array(i)), early["early_id"].take(pa.array(j)), pa.array(score)], names=names)

    kind = notes.schema["note_id"].dataType
    found = late.groupBy("b", "e").cogroup(early.groupBy("late_b", "early_b")).applyInArrow(run, T.StructType([T.StructField("note_id", kind), T.StructField("earlier", kind), T.StructField("score", T.DoubleType())]))
    return top_k(found, ["note_id"], [F.col("score").desc(), F.col("earlier").asc()], k).select("note_id", "earlier", "rank", "score")


#: A saved note: what it says, what it is known by, and its links.
NOTE = "note_id bigint, content string, summary string, keywords array<string>, links array<bigint>, visual boolean"


def save_memory(notes: DataFrame, vectors: DataFrame, path: str) -> None:
    """Writes ``notes`` (columns of ``NOTE``; missing ones are null) and their ``vectors(note_id, vec)`` as tables below the path, in place of what is
    there. A memory without notes, or with a note without a vector or the other way, isn't written."""
    held = notes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in notes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(NOTE)])
    ids, of = held.select("note_id"), vectors.select("note_id")
    if held.isEmpty():
        raise ValueError("a memory without notes isn't saved")
    if not ids.join(of, "note_id", "left_anti").isEmpty() or not of.join(ids, "note_id", "left_anti").isEmpty():
        raise ValueError("each note has a vector, and each vector a note")
    held.write.mode("overwrite").parquet(f"{path}/notes")
    vectors.select("note_id", F.col("vec").cast("array<double>").alias("vec")).write.mode("overwrite").parquet(f"{path}/vectors")


def load_memory(spark: SparkSession, path: str) -> DataFrame:
    """The saved notes with their vectors: columns of ``NOTE``, vec. A memory that has no notes, or other numbers of notes and vectors, is no memory."""
    held = spark.read.schema(NOTE).parquet(f"{path}/notes")
    vectors = spark.read.schema("note_id bigint, vec array<double>").parquet(f"{path}/vectors").withColumnRenamed("note_id", "of_note")
    n, m = held.count(), vectors.count()
    if not n or n != m:
        raise ValueError(f"{path} has {n} notes and {m} vectors")
    return held.join(vectors, F.col("note_id") == F.col("of_note")).drop("of_note")
