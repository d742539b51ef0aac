"""Plans of sub-questions as graphs: validity, levels and execution order of each."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def waves(ids: list, children: list[list]) -> tuple[list[int], list[int]]:
    """Order and level of nodes by in-degrees: those free go first come first served and free their children; nodes on
    or behind a cycle are never freed and have -1. Of nodes of one id the last one's children count; children that aren't nodes
    are skipped, repeated ones count again."""
    place: dict = {}
    for node in ids:
        place.setdefault(node, len(place))
    after: list[list[int]] = [[] for _ in place]
    waiting = [0] * len(place)
    for node, found in zip(ids, children, strict=True):
        for child in found or ():
            if child in place:
                after[place[node]].append(place[child])
                waiting[place[child]] += 1
    level, order = [0] * len(place), [-1] * len(place)
    queue = [i for i, n in enumerate(waiting) if not n]
    for at, node in enumerate(queue):  # grows while it is walked
        order[node] = at
        for child in after[node]:
            level[child] = max(level[child], level[node] + 1)
            waiting[child] -= 1
            if not waiting[child]:
                queue.append(child)
    return [order[place[n]] for n in ids], [level[place[n]] if order[place[n]] >= 0 else -1 for n in ids]


def execution_order(nodes: DataFrame, graph: str, max_nodes: int = 100_000) -> DataFrame:
    """``(graph, node, position, level, unknown, valid, reason)`` per row of ``nodes(graph, ordinal, node, children)``.

    Position and level from 0; ``unknown`` has the children that aren't nodes of the graph, which are skipped. A graph with a
    cycle, or of more than ``max_nodes`` nodes, is not valid (``reason``) and its positions are the order its nodes are written in, level null:
    what runs then is the plain way for its question. Graphs that are too large are told before anything is gathered, so a task
    holds one graph of at most that size; what is gathered are ids only.
    """
    given = nodes.select(graph, "ordinal", "node", F.coalesce("children", F.array().cast(nodes.schema["children"].dataType)).alias("children"))
    sizes = given.groupBy(F.col(graph).alias("of")).agg((F.count("*") > max_nodes).alias("large")).where("large")
    large = given.join(sizes, F.col(graph).eqNullSafe(F.col("of")), "left_semi")
    small = given.join(sizes, F.col(graph).eqNullSafe(F.col("of")), "left_anti")
    kinds = [nodes.schema[graph], nodes.schema["ordinal"], nodes.schema["node"]]
    out = T.StructType([*kinds, T.StructField("position", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("unknown", nodes.schema["children"].dataType), T.StructField("reason", T.StringType())])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ordinal")
        ids, children = rows["node"].to_pylist(), rows["children"].to_pylist()
        order, level = waves(ids, children)
        cyclic, known = -1 in order, set(ids)
        unknown = [[c for c in found if c not in known] for found in children]
        columns = [
            pa.array(range(len(ids)) if cyclic else order, pa.int32()),
            pa.array([None if cyclic else x for x in level], pa.int32()),
            pa.array(unknown, rows["children"].type),
            pa.array(["cycle" if cyclic else None] * len(ids), pa.string()),
        ]
        return pa.table([rows[graph], rows["ordinal"], rows["node"], *columns], names=[f.name for f in out])

    none = F.lit(None)
    found = small.groupBy(graph).applyInArrow(run, out)
    kept = large.select(graph, "ordinal", "node", none.cast("int").alias("position"), none.cast("int").alias("level"), F.array().cast(nodes.schema["children"].dataType).alias("unknown"), F.lit("too many nodes").alias("reason"))
    return found.unionByName(kept).select(graph, "ordinal", "node", "position", "level", "unknown", F.col("reason").isNull().alias("valid"), "reason")
