"""What several operators of this subpackage need: shared scratch tables, what workers keep, and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.sources.scratch import shared_root


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those of these names, in any case: Spark doesn't tell cases apart."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in short ones, so that few texts are Python objects at a time."""
    let_go()
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


_RESIDENT: dict = {}  # of this worker: values with the Spark stage whose task asked for them last


def _stage() -> int | None:
    task = TaskContext.get()
    return task and task.stageId()


def resident(key: tuple, make: Callable[[], object]):
    """What a worker keeps for the tasks of a Spark stage, made by the first of them."""
    if key not in _RESIDENT:
        let_go()
    value = _RESIDENT[key][0] if key in _RESIDENT else make()
    _RESIDENT[key] = (value, _stage())
    return value


def let_go() -> None:
    """Workers outlive stages: at the start of a task goes what tasks of other stages asked for."""
    now = _stage()
    for key in [k for k, (_, stage) in _RESIDENT.items() if stage != now]:
        del _RESIDENT[key]


class Recent:
    """A table of a worker that keeps what was used lately: when its entries pass ``size`` bytes, those of the round before go."""

    def __init__(self, size: int, width: int = 1):
        """``width``: bytes that each part of a value takes."""
        self.size, self.width, self.held, self.now, self.old = size, width, 0, {}, {}

    def lacking(self, keys: set) -> set:
        """The keys that are not in ``now``; those of the round before come back first."""
        out = keys.difference(self.now)
        if self.old and out:
            new = out.difference(self.old)
            self.add({k: self.old[k] for k in out.difference(new)})
            out = new
        return out

    def add(self, entries: dict) -> None:
        """About 190 bytes go with an entry besides its parts."""
        self.now.update(entries)
        self.held += 190 * len(entries) + sum(map(len, entries)) + self.width * sum(map(len, entries.values()))

    def turn(self) -> None:
        """Between batches: what a batch needs stays in ``now``."""
        if self.held > self.size:
            self.old, self.now, self.held = self.now, {}, 0


#: Rows that move at a time between Parquet, Spark and Python where they hold texts.
SHORT_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.parquet.columnarReaderBatchSize": 1000}


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """For what is run inside: texts move in batches of ``SHORT_BATCH``, so their buffers are a few MB in the executor and in its workers."""
    before = {k: spark.conf.get(k) for k in SHORT_BATCH}
    for k, most in SHORT_BATCH.items():
        if not 0 < int(before[k]) <= most:
            spark.conf.set(k, str(most))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


_MADE: ContextVar[list | None] = ContextVar("made", default=None)


@contextmanager
def tidy() -> Iterator[None]:
    """Drops at its end all scratch tables that were begun inside: for results that are written elsewhere by then."""
    made: list[Scratch] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for scratch in made:
            scratch.leave()


class Scratch:
    """Parquet tables of one operator call, in a folder of their own below the shared root.

    A table cuts the lineage: a lost executor costs the tasks that read it again, not what made it.
    Tables that a returned (lazy) DataFrame reads must stay; ``drop`` is for the others.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/docquarry/{what}-{uuid.uuid4().hex}"
        if (made := _MADE.get()) is not None:
            made.append(self)

    def keep(self, df: DataFrame, name: str, texts: bool = False) -> DataFrame:
        """``texts``: rows that are read or made here hold texts or the like and move in short batches."""
        path = f"{self.root}/{name}"
        with short_batches(self.spark) if texts else nullcontext():
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _place(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, name: str) -> None:
        path, store = self._place(name)
        store.delete(path, True)

    def leave(self, *names: str) -> None:
        """Drops all tables but these, which what is returned still reads."""
        root, store = self._place("")
        for status in store.listStatus(root) if store.exists(root) else ():
            if status.getPath().getName() not in names:
                store.delete(status.getPath(), True)


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node reached.

    Alternating large-star and small-star steps. Each step is a grouped minimum and an equi-join, so a
    hub's edges are summed on the map side and a join on it can be split; nothing is gathered per node.
    Rounds grow with the logarithm of the longest chain. Edges are null-free; loops are ignored.
    """
    e = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    state = None
    for i in range(1, max_rounds + 1):
        # large star: every node's larger neighbours move to its smallest neighbour
        up = e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        large = scratch.keep(e.join(up, e.b == up.u, "left").select("a", F.coalesce("m", "b").alias("b")).where("a <> b").distinct(), f"{name}-l{i}")
        # small star: every node's smaller neighbours move to the smallest of them
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        moved = large.join(low, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e_next = scratch.keep(moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), f"{name}-{i}")
        now = tuple(e_next.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        for old in (f"{name}-{i - 1}", f"{name}-l{i}"):
            scratch.drop(old)
        e = e_next
        if now == state or now[0] == 0:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
