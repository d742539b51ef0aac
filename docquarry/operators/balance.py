"""Balanced partitions by largest differencing (Karmarkar-Karp), as states that merge up a tree.

A state holds some of the rows dealt into k bins. Merging two states puts the fullest bins of one on the emptiest of the
other; the two of the largest spread are merged first. Up to ``top`` rows are states of their own and merged in one task: the
method as it is. Of more, rows smaller than the ``fine``-th part of a bin are bundled in their tasks until they
are that large, so that at most about 2 * ``fine`` * k states, and one a task, are left to merge, and sums differ by about a bundle at most. Equal numbers need groups of k rows
of like size; those of a chunk are merged in their task. So a task holds ``top`` rows or states, and no window orders all rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.sources.scratch import keep


def difference(states: list[tuple[list[int], object]]) -> tuple[list[int], list[list[int]]]:
    """Merges states ``(sums of the bins, ascending; name)``: the sums of what is left, and for each bin the names in it.

    A name stands for all bins of its state: entry b of the result's list of a bin is ``(name, bin of that state)``.
    """
    # a bin is a pair (sum, tree of members), a state a list of k of them by ascending sum
    heap = []
    for i, (sums, name) in enumerate(states):
        bins = sorted(((s, (name, b)) for b, s in enumerate(sums)), key=lambda x: x[0])
        heap.append((bins[0][0] - bins[-1][0], i, bins))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, i, two = heapq.heappop(heap)
        both = sorted(((a + b, [x, y]) for (a, x), (b, y) in zip(one, reversed(two), strict=True)), key=lambda x: x[0])
        heapq.heappush(heap, (both[0][0] - both[-1][0], n + i, both))
    bins = heap[0][2]
    members = []
    for _, tree in bins:
        found, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                todo.extend(x)
            else:
                found.append(x)
        members.append(found)
    return [s for s, _ in bins], members


def _bundles(sizes: np.ndarray, least: float) -> np.ndarray:
    """Numbers of consecutive bundles: each ends with the row that takes it to ``least``."""
    out, n, total = np.zeros(len(sizes), np.int64), 0, 0
    for i, s in enumerate(sizes.tolist()):
        out[i] = n
        total += s
        if total >= least:
            n, total = n + 1, 0
    return out


def karmarkar_karp(rows: DataFrame, size: str, key: str, bins: int, equal_size: bool = False, top: int = 50_000, fine: int = 512) -> DataFrame:
    """``(key, size, bin)``: a bin of 0 to ``bins`` - 1 for each row, sums as equal as largest differencing makes them.

    ``equal_size``: bins get equally many rows (within one of each other up to ``top`` rows, and one a chunk of so many beyond). A null size
    counts as 0; sizes aren't negative. Rows of equal key are rows of their own.
    """
    given = rows.select(key, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(size))
    count, total = given.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    least = 0.0 if count <= top else max(1.0, total / (bins * fine))
    ordered = given.repartition(max(1, -(-count // top)), F.xxhash64(key)).sortWithinPartitions(F.col(size), F.col(key))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36  # names of states: the task above, what is in it below
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            sizes = table.column(1).to_numpy()
            if equal_size:
                groups = [range(a, min(len(sizes), a + bins)) for a in range(0, len(sizes), bins)]
                _, members = difference([([0] * (bins - len(g)) + sizes[g.start : g.stop].tolist(), g) for g in groups])
                state, place = np.full(len(sizes), first), np.zeros(len(sizes), np.int32)
                for b, found in enumerate(members):
                    for g, of in found:
                        if (at := g.stop - bins + of) >= g.start:
                            place[at] = b
            else:
                state, place = first + _bundles(sizes, least), np.full(len(sizes), bins - 1, np.int32)
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in table.columns), pa.array(state), pa.array(place)], names=[key, size, "state", "bin"])

        for batch in batches:
            while held and sum(b.num_rows for b in held) + batch.num_rows > top:
                room = top - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                yield out()
                held, first = [], first + (1 << 20)
            held.append(batch)
        if held:
            yield out()

    kinds = T.StructType([rows.schema[key], T.StructField(size, T.LongType()), T.StructField("state", T.LongType()), T.StructField("bin", T.IntegerType())])
    placed = keep(ordered.mapInArrow(dealt, kinds), "balanced")
    states = placed.groupBy("state", "bin").agg(F.sum(size).alias("sum"))
    while (left := states.select("state").distinct().count()) > 1:
        group = F.pmod(F.xxhash64("state"), F.lit(-(-left // top)))
        numbered = keep(states.withColumn("group", group), "balance-states")

        def merged(held: pa.Table) -> pa.Table:
            by: dict[int, list[int]] = {}
            for s, b, total in sorted(zip(*(held[c].to_pylist() for c in ("state", "bin", "sum")), strict=True)):
                by.setdefault(s, [0] * bins)[b] = total
            _, members = difference([(sums, s) for s, sums in by.items()])
            rows = [(s, of, b) for b, found in enumerate(members) for s, of in found]
            group = held["group"][0].as_py()
            return pa.table({"of_state": [r[0] for r in rows], "of_bin": pa.array([r[1] for r in rows], pa.int32()), "to_state": [group] * len(rows), "to_bin": pa.array([r[2] for r in rows], pa.int32())})

        moves = keep(numbered.groupBy("group").applyInArrow(merged, "of_state long, of_bin int, to_state long, to_bin int"), "balance-moves")
        moved = lambda x: x.join(moves, (F.col("state") == F.col("of_state")) & (F.col("bin") == F.col("of_bin")))  # noqa: E731, B023
        states = keep(moved(numbered).groupBy(F.col("to_state").alias("state"), F.col("to_bin").alias("bin")).agg(F.sum("sum").alias("sum")), "balance-merged")
        placed = moved(placed).select(key, size, F.col("to_state").alias("state"), F.col("to_bin").alias("bin"))
    return placed.select(key, size, "bin")
