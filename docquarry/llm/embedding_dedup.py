"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one representative a group.

Equal vectors of a label meet first and go on as one with their number. The vectors of a label are cut into cells by
spherical k-means, at every size: cells of about ``cell`` vectors, a vector in the ``probes`` cells of its largest cosines,
so that a pair near a border meets in one of them. Products within a cell are formed by blocks of rows in double
precision; a pair counts in the first cell it shares. With no more cells than probes every pair of a label is
compared; beyond that a partner can be missed, a test holds the recall against all pairs.

Parts: a label of more than ``part`` vectors is first cut into parts by k-means, one for ``part`` / 2 vectors, at most
``max_parts`` at a time; a vector goes to the parts of its ``probes`` largest cosines. What that many parts leave too large
is cut again, up to ``LEVELS`` times. A fit sees 16 vectors a part (16,384 at most) and gives a row of a table, which meets the vectors
of its label in blocks: no centroids pass the driver or are broadcast. Cells are made inside a part. So what is shuffled is in
proportion to the vectors.
A part of more than 2 * ``part`` vectors, as a very crowded cluster makes one, is dealt into blocks whose pairs are tasks.
From a task leave, for each vector, its number of links and one edge to the smallest vector of its component, never
the pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, or whose label is null, link
with nothing and are their own component. Vectors of unequal length are compared within their length only. Rows of
equal vec_id count as separate vectors for n_links and share a component. Rows of null vec_id link with nothing. Empty
tables give empty results. Extra columns are of no account, and pass through ``deduplicate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm._shared import Scratch, connected_components


#: How often parts are cut into parts.
LEVELS = 3


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)  # huge components don't overflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of unit vectors; starts from evenly spread rows, so it is deterministic."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        order = np.argsort(home, kind="stable")
        there, starts = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(x[order], starts, axis=0)
        size = np.linalg.norm(sums, axis=1)
        c[there[size > 0]] = sums[size > 0] / size[size > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray, probes: int) -> np.ndarray:
    """The numbers of the nearest centroids of each vector, ascending."""
    p = min(probes, len(c))
    if p == len(c):
        return np.tile(np.arange(p), (len(x), 1))
    return np.sort(np.concatenate([np.argpartition(-(x[a : a + 4096] @ c.T), p - 1, axis=1)[:, :p] for a in range(0, len(x), 4096)]), axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


_KEY = ("label", "dim", "path")


def _same(sizes: DataFrame) -> Column:
    return (F.col("label") == sizes["of_label"]) & (F.col("dim") == sizes["of_dim"]) & (F.col("path") == sizes["of_path"])


def _of_key(rows: DataFrame, *values: Column) -> DataFrame:
    return rows.groupBy(*[F.col(c).alias(f"of_{c}") for c in _KEY]).agg(*values)


def _split(members: DataFrame, part: int, max_parts: int, probes: int, scratch: Scratch, name: str) -> DataFrame | None:
    """``members`` with what is ``open`` and too large cut into parts; None if nothing is.

    ``path`` has the parts a row lies in, level by level, and ``homes`` those its vector goes to on each level.
    """
    wanted = F.ceil(2 * F.col("count") / part)
    sizes = _of_key(members.where("open"), F.count("*").alias("count")).where(F.col("count") > part)
    sizes = sizes.select("of_label", "of_dim", "of_path", F.least(F.lit(max_parts), wanted).cast("int").alias("k"), (wanted > max_parts).alias("capped"), "count")
    sizes = scratch.keep(sizes.withColumn("blocks", F.ceil(F.col("count") / 8192).cast("int")), f"sizes-{name}")
    if sizes.isEmpty():
        return None
    met = members.where("open").join(sizes, _same(sizes))
    drawn = met.where(F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53)) < 16 * F.col("k") / F.col("count")).select("id", *_KEY, "embedding", "k", "blocks", "capped")

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        x = _unit(_matrix(rows["embedding"].combine_chunks()))
        c = spherical_kmeans(x, min(rows["k"][0].as_py(), len(x)))
        return rows.select([*_KEY, "blocks"]).slice(0, 1).append_column("c", pa.array([c.tobytes()], pa.binary()))

    kinds = [members.schema[c] for c in _KEY]
    centroids = scratch.keep(drawn.groupBy(*_KEY).applyInArrow(fit, T.StructType([*kinds, T.StructField("blocks", T.IntegerType()), T.StructField("c", T.BinaryType())])), f"centroids-{name}")
    centroids = centroids.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*_KEY, "block", "c")
    rows = met.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select(*members.columns, "block", "capped")
    out = T.StructType([*rows.drop("block", "open").schema.fields, T.StructField("near", T.ArrayType(T.IntegerType()))])

    def run(held: pa.Table, fitted: pa.Table) -> pa.Table:
        kept = held.select([f.name for f in out.fields[:-1]])
        if not held.num_rows:
            return kept.append_column("near", pa.array([], pa.list_(pa.int32())))
        # a label whose sample came out empty stays one part
        c = np.frombuffer(fitted["c"][0].as_py()).reshape(-1, held["dim"][0].as_py()) if fitted.num_rows else np.zeros((1, held["dim"][0].as_py()))
        near = _nearest(_unit(_matrix(held["embedding"].combine_chunks())), c, probes)
        return kept.append_column("near", pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())))

    keys = (*_KEY, "block")
    cut = rows.groupBy(*keys).cogroup(centroids.groupBy(*keys)).applyInArrow(run, out).withColumn("part", F.explode("near"))
    cut = cut.withColumns({"path": F.concat("path", F.array("part")), "homes": F.concat("homes", F.array("near")), "open": F.col("capped")}).select(*members.columns)
    rest = members.join(sizes, _same(sizes) & F.col("open"), "left_anti")
    return scratch.keep(cut.unionByName(rest), f"members-{name}")


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites the sets of i and j in ``root``, which holds the smallest member of each set."""
    while True:
        a, b = root[i], root[j]
        if not (differ := a != b).any():
            return
        i, j = i[differ], j[differ]
        np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (root[root] != root).any():
            root[:] = root[root]


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that rows of both have."""
    return np.where(a[:, :, None] == b[:, None, :], a[:, :, None], np.iinfo(a.dtype).max).min(axis=(1, 2))


def _compare(threshold: float, cell: int, probes: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, times, block = (rows[c].to_numpy() for c in ("id", "n", "block"))
        path, bi, bj = (rows[c][0].as_py() for c in ("path", "bi", "bj"))
        homes = rows["homes"].combine_chunks()
        ends = np.cumsum([len(near) for near in homes[0].as_py()])
        levels = np.split(homes.flatten().flatten().to_numpy().astype(np.int64).reshape(len(rows), -1), ends[:-1], axis=1) if path else []
        x = _unit(_matrix(rows["embedding"].combine_chunks()))
        k = min(len(x), max(2, -(-len(x) // cell)))
        cells = _nearest(x, spherical_kmeans(x[np.linspace(0, len(x) - 1, min(len(x), 16 * k)).astype(int)], k), probes)
        links, root = np.zeros(len(x), np.int64), np.arange(len(x))
        for c in range(k):
            at = np.flatnonzero((cells == c).any(1))
            for a in range(0, len(at), 512):
                i, j = np.nonzero(x[at[a : a + 512]] @ x[at[a:]].T >= threshold)
                i, j = at[a + i[j > i]], at[a + j[j > i]]
                here = _first_shared(cells[i], cells[j]) == c
                for near, part in zip(levels, path, strict=True):
                    here &= _first_shared(near[i], near[j]) == part
                if bi != bj:
                    here &= block[i] != block[j]
                i, j = i[here], j[here]
                np.add.at(links, i, times[j])
                np.add.at(links, j, times[i])
                _joined(root, i, j)
        some = np.flatnonzero(links)
        return pa.table({"h": rows["h"].to_numpy()[some], "id": ids[some], "root": ids[root[some]], "links": links[some]})

    return run


def links(vectors: DataFrame, threshold: float, cell: int, probes: int, part: int, max_parts: int, scratch: Scratch) -> DataFrame:
    """``(h, id, root, links)`` parts of every distinct vector's links; ``vectors`` is (h, id, label, dim, embedding, n)."""
    members = vectors.withColumns({"path": F.array().cast("array<int>"), "homes": F.array().cast("array<array<int>>"), "open": F.lit(True)})
    split = False
    for level in range(LEVELS):
        cut = _split(members, part, max_parts, probes, scratch, str(level))
        if cut is None:
            break
        members, split = cut, True
    if split:
        crowded = _of_key(members, F.ceil(F.count("*") / part).cast("int").alias("blocks"), F.count("*").alias("count")).where(F.col("count") > 2 * part).drop("count")
        members = members.join(crowded, _same(crowded), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        members = members.withColumn("blocks", F.lit(1))
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = members.select("h", "id", "n", "embedding", "homes", *_KEY, "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    return pairs.groupBy(*_KEY, "bi", "bj").applyInArrow(_compare(threshold, cell, probes), "h long, id long, root long, links long")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, cell: int = 512, probes: int = 3, part: int = 32_768, max_parts: int = 1024) -> DataFrame:
    """Per row of ``embeddings(vec_id, embedding, label)``: vec_id, n_links, component_id, kept."""
    scratch = Scratch(embeddings.sparkSession, "embeddings")
    rows = embeddings.select("vec_id", "embedding", "label")
    sound = (
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & (F.coalesce(F.size("embedding"), F.lit(0)) > 0)
        & F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    )
    # 128 bits of hash say which vectors are equal
    rows = rows.withColumns({"h": F.when(sound, F.xxhash64("label", "embedding")), "g": F.xxhash64(F.lit("g"), "embedding", "label")})
    first = F.min_by(F.struct("label", F.size("embedding").alias("dim"), "embedding"), "vec_id")
    distinct = rows.where("h is not null").groupBy("h", "g").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), first.alias("v"))
    distinct = scratch.keep(distinct.select("h", "g", "id", "n", "v.label", "v.dim", "v.embedding"), "distinct")
    found = scratch.keep(links(distinct.drop("g"), threshold, cell, probes, part, max_parts, scratch), "links")
    sums = found.groupBy(F.col("h").alias("sum_h")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    classes = (
        distinct.select(F.col("h").alias("of_h"), F.col("g").alias("of_g"), "id", "n").join(sums, F.col("of_h") == F.col("sum_h"), "left").join(parts, F.col("id") == F.col("node"), "left")
        .select("of_h", "of_g", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    classes = scratch.keep(classes, "classes")
    scratch.leave("classes")
    out = rows.select("vec_id", "h", "g").join(classes, (F.col("h") == F.col("of_h")) & (F.col("g") == F.col("of_g")), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id") == F.col("component_id")
    )


def deduplicate(embeddings: DataFrame, **options) -> DataFrame:
    """``embeddings`` with one representative of each group, that of the smallest vec_id."""
    gone = near_duplicates(embeddings, **options).where("not kept").select(F.col("vec_id").alias("gone_id")).distinct()
    return embeddings.join(gone, embeddings["vec_id"] == gone["gone_id"], "left_anti")
