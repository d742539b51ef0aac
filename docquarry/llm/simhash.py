"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints of at most 2 differing bits, cut into two halves, have a half that differs by at most one
bit. So each half is indexed under its 32 variants with one bit wildcarded; fingerprints that are linked share a
variant, and an equality join on it finds them all. A variant shared by two fingerprints gives a pair whose
differing bits are counted. Members of a variant shared by more are verified by a second equality: two
fingerprints differ in at most 2 bits if and only if they share a neighbour that each reaches by at most one flip.
So a bucket of any size gives rows in proportion to its members, never all pairs.

Scale: texts stay in the map that makes fingerprints; what is shuffled is 64 short rows for each distinct
fingerprint (copies meet before that, summed on the map side), and the labels of the linked ones. No list of a
bucket, component or fingerprint table reaches one task or the driver.

Edge cases: a text without words, null included, has fingerprint zero and links like any other. Rows of equal
doc_id are one document; a null doc_id is never the smallest of a component unless it holds nothing else (then the
component_id is null). An empty table gives an empty result.

``deduplicate`` serves the pipeline and has another contract: sets of 5-word shingles of similarity 0.8 or more, by fingerprints and
MinHash bands of these sets, each pair compared exactly. Its
rows of null doc_id stay and take no part, texts without words are copies of each other, extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm._shared import Scratch, connected_components, slices


def majority(h: np.ndarray) -> int:
    """The signed 64-bit fingerprint of hashes: the bits set in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 200_000):
        ones += np.unpackbits(h[i : i + 200_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    ends = starts[min(shingle, len(words)) :]
    h = np.fromiter((xxh64_intdigest(line[a : b - 1], seed) for a, b in zip(starts, ends)), np.uint64, n)  # noqa: B905
    return majority(h)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` per row of ``docs``."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())]))


def signatures(fps: DataFrame) -> DataFrame:
    """``(key, fp)``: 64 one-wildcard variants of the halves of each fingerprint; the key holds wildcard and half."""
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    variants = [F.lit(p << 32).bitwiseOR((low if p < 32 else high).bitwiseAND(0xFFFFFFFF ^ (1 << (p % 32)))) for p in range(64)]
    return fps.select("fp", F.explode(F.array(*variants)).alias("key"))


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """``(a, b)`` edges between distinct fingerprints that have the components of all pairs of at most 2 bits."""
    buckets = scratch.keep(
        signatures(fps).groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets"
    )
    pairs = buckets.where("n = 2 and bit_count(a ^ b) <= 2").select("a", "b")
    wide = buckets.where("n > 2").select(F.col("key").alias("wide_key"))
    members = scratch.keep(signatures(fps).join(wide, F.col("key") == F.col("wide_key"), "left_semi").select("fp").distinct(), "members")
    flips = F.array(F.col("fp"), *[F.expr(f"fp ^ {1 << p}L" if p < 63 else "fp ^ (-9223372036854775807L - 1L)") for p in range(64)])
    # a neighbour is within one flip of 65 fingerprints at most, so these windows are small whatever the data
    near = members.select("fp", F.explode(flips).alias("v")).withColumn("b", F.min("fp").over(Window.partitionBy("v")))
    found = near.where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(found).distinct()


def components(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """``(fp, component_id)`` for each distinct fingerprint of ``fps(doc_id, fp)``."""
    distinct = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    labels = scratch.keep(connected_components(links(distinct.select("fp"), scratch), scratch), "labels")
    held = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first_doc", F.coalesce("component", "fp").alias("component"))
    held = scratch.keep(held, "held")
    least = held.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    return scratch.keep(held.join(least, "component").select("fp", "component_id"), "components")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, shingle), "fps", texts=True)
    found = components(fps, scratch).withColumnRenamed("fp", "of")
    scratch.leave("fps", "components")
    return fps.join(found, F.col("fp") == F.col("of")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: MinHash bands and rows a band: of pairs of similarity 0.8, one in 40,000 shares no band.
BANDS, ROWS = 20, 4
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; the whole text is one if it has fewer words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    line = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    ends = starts[min(shingle, len(words)) :] if words else []
    return np.array(sorted({xxh64_intdigest(line[a : b - 1], 42) for a, b in zip(starts, ends)}), np.uint64)  # noqa: B905


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each MinHash band of a set of hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 1000):
            np.minimum(least, (hashes[i : i + 1000, None] * _FACTORS).min(axis=0), out=least)
        key = np.arange(BANDS, dtype=np.uint64)
        for column in least.reshape(BANDS, ROWS).T:
            key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _set_id(hashes: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    h = xxh3_64_intdigest(hashes.tobytes())
    return h - (h >> 63 << 64)


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, set, n, print, keys)`` per row: id, size and SimHash fingerprint of its set of shingles, and the keys of its bands."""
    rows = docs.where("doc_id is not null").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(t, shingle) for t in batch.column(1).to_pylist()]
            keys = [band_keys(h) if len(h) else [] for h in found]
            arrays = [batch.column(0), pa.array([_set_id(h) for h in found], pa.int64()), pa.array([len(h) for h in found], pa.int64())]
            arrays += [pa.array([majority(h) for h in found], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "set", "n", "print", "keys"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("set long, n long, print long, keys array<long>").fields]))


def _hashes(docs: DataFrame, distinct: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``(set, hashes)``: the shingles of the sets of ``wanted(set)``, from the first document of each."""
    first = distinct.join(wanted, "set", "left_semi").select("set", "first_doc")
    rows = docs.select("doc_id", "text").join(first.select(F.col("first_doc").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(t, shingle) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], names=["set", "hashes"])

    # rows of an equal doc_id may have other texts
    return rows.mapInArrow(run, "set long, hashes binary").join(first.select("set"), "set", "left_semi").groupBy("set").agg(F.first("hashes").alias("hashes"))


def _alike(pairs: DataFrame, hashes: DataFrame, similar: float) -> DataFrame:
    """The pairs ``(a, b)`` of sets whose exact similarity, shared shingles / all shingles, is enough."""
    end = lambda x: hashes.select(F.col("set").alias(f"set_{x}"), F.col("hashes").alias(f"hashes_{x}"))
    joined = pairs.join(end("a"), F.col("a") == F.col("set_a")).join(end("b"), F.col("b") == F.col("set_b")).select("a", "b", "hashes_a", "hashes_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similar * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def rare_shingles(hashes: DataFrame, similar: float, scratch: Scratch) -> DataFrame:
    """``(hash, set, n, place, indexed)``: the shingles by which two sets of ``hashes(set, hashes)`` can find each other.

    Shingles are ordered by the number of sets that have them, so those of one set only come first. Two sets of that similarity share
    one of the first n - ceil(similar * n) + 1 of the larger, which is ``indexed`` (among the first
    n - ceil(2 * similar / (1 + similar) * n) + 1) in the smaller. What many sets share is seldom among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            found = [np.frombuffer(h, np.int64) for h in batch.column(1).to_pylist()]
            sizes = np.array([len(h) for h in found])
            sets = np.repeat(batch.column(0).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(sets), pa.array(np.repeat(sizes, sizes))], names=["hash", "set", "n"])

    rows = scratch.keep(hashes.mapInArrow(run, "hash long, set long, n long"), "shingles", texts=True)
    several = scratch.keep(rows.groupBy(F.col("hash").alias("of")).agg(F.count("*").alias("times")).where("times > 1"), "several")
    shared = rows.join(several, F.col("hash") == F.col("of")).groupBy("set", "n").agg(F.array_sort(F.collect_list(F.struct("times", "hash"))).alias("shared"))
    probe = F.col("n") - F.ceil(similar * F.col("n") - 1e-9) + 1
    index = F.col("n") - F.ceil(2 * similar / (1 + similar) * F.col("n") - 1e-9) + 1
    alone = F.col("n") - F.size("shared")
    first = shared.where(probe > alone).select("set", "n", alone.alias("alone"), index.alias("index"), F.posexplode(F.slice("shared", F.lit(1), (probe - alone).cast("int"))).alias("pos", "s"))
    first = first.select("set", "n", "index", (F.col("alone") + F.col("pos")).alias("place"), F.col("s.hash").alias("hash"))
    return scratch.keep(first.select("hash", "set", "n", "place", (F.col("place") < F.col("index")).alias("indexed")), "rare")


def _meeting(rare: DataFrame, labels: DataFrame, similar: float, turn: int | None) -> DataFrame:
    """Pairs ``(a, b)`` of sets of two components that share a rare shingle and may be similar; with a turn, one set a component and shingle."""
    held = rare.join(labels, F.col("set") == F.col("node"), "left").select("hash", "set", "n", "place", "indexed", F.coalesce("component", "set").alias("component"))
    if turn is not None:
        # the same for both ends: whether a component's set is the indexed one matters, so each kind has its own
        pick = F.struct(F.xxhash64("set", F.lit(turn)), "set", "n", "place")
        held = held.groupBy("hash", "component", "indexed").agg(F.min(pick).alias("p")).select("hash", "p.set", "p.n", "p.place", "indexed", "component")
    small = held.where("indexed").select("hash", F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"), F.col("component").alias("component_a"))
    large = held.select("hash", F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), F.col("component").alias("component_b"))
    fits = (F.col("n_a") <= F.col("n_b")) & (F.col("n_a") >= similar * F.col("n_b") - 1e-9) & (F.col("a") != F.col("b")) & (F.col("component_a") != F.col("component_b"))
    room = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))  # if it is the first shared one
    fits &= room >= similar / (1 + similar) * (F.col("n_a") + F.col("n_b")) - 1e-9
    met = small.join(large, "hash").where(fits)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def print_pairs(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidate pairs ``(a, b, n_a, n_b)`` of ``distinct(set, n, print)``: the first sets of fingerprints that ``links`` finds at most 2 bits apart, and the first
    set of a fingerprint with each other one of it."""
    firsts = scratch.keep(distinct.groupBy(F.col("print").alias("fp")).agg(F.min(F.struct("set", "n")).alias("first")), "prints")
    near = scratch.keep(links(firsts.select("fp"), scratch), "print-links")
    end = lambda x: firsts.select(F.col("fp").alias(f"fp_{x}"), F.col("first").alias(f"first_{x}"))
    apart = near.join(end("a"), F.col("a") == F.col("fp_a")).join(end("b"), F.col("b") == F.col("fp_b")).select("first_a", F.col("first_b.set").alias("b"), F.col("first_b.n").alias("n_b"))
    same = distinct.join(firsts, F.col("print") == F.col("fp")).select(F.col("first").alias("first_a"), F.col("set").alias("b"), F.col("n").alias("n_b"))
    return apart.unionByName(same).select(F.col("first_a.set").alias("a"), "b", F.col("first_a.n").alias("n_a"), "n_b")


def near_copies(docs: DataFrame, scratch: Scratch, shingle: int = 5, similar: float = 0.8) -> DataFrame:
    """``(doc_id, component_id)`` of documents linked by sets of shingles of at least that similarity.

    Candidates are sets whose SimHash fingerprints differ by at most 2 bits, found through deletion variants as ``near_duplicates``
    finds them, and an exact comparison follows. A few bits of a 64-bit fingerprint don't reach all such pairs (their median is about
    10 bits), so sets that share one of the MinHash bands are candidates too: each set is compared with the first one of its bands, which
    joins near copies at a cost in proportion to their number. Sets of bands that aren't one component then meet by their rare shingles: first one set a
    component and shingle, in two turns, then all that are still apart. That loses no pair, and documents that
    share much without being copies (boilerplate of one site) have only shingles of their own there.
    """
    sets = scratch.keep(_sets(docs, shingle), "sets", texts=True)
    distinct = scratch.keep(sets.groupBy("set").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("print").alias("print"), F.first("keys").alias("keys")), "distinct-sets")
    members = distinct.select("set", "n", F.explode("keys").alias("key"))
    first = members.groupBy(F.col("key").alias("bucket")).agg(F.count("*").alias("size"), F.min(F.struct("set", "n")).alias("first")).where("size > 1")
    members = scratch.keep(members.join(first, F.col("key") == F.col("bucket")).select("key", "set", "n", F.col("first.set").alias("lead"), F.col("first.n").alias("lead_n")), "band-members")
    near = print_pairs(distinct.select("set", "n", "print"), scratch).unionByName(members.select(F.col("lead").alias("a"), F.col("set").alias("b"), F.col("lead_n").alias("n_a"), F.col("n").alias("n_b")))
    fits = F.least("n_a", "n_b") >= similar * F.greatest("n_a", "n_b") - 1e-9
    pairs = scratch.keep(near.where((F.col("a") != F.col("b")) & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "lead-pairs")
    wanted = members.select("set").unionByName(pairs.select(F.col("a").alias("set"))).unionByName(pairs.select(F.col("b").alias("set")))
    hashes = scratch.keep(_hashes(docs, distinct, wanted.distinct(), shingle), "hashes", texts=True)
    found = scratch.keep(_alike(pairs, hashes, similar), "alike-leads", texts=True)
    labels = scratch.keep(connected_components(found, scratch, "lead-cc"), "lead-labels")
    held = members.join(labels, F.col("set") == F.col("node"), "left").select("key", "set", F.coalesce("component", "set").alias("component"))
    mixed = held.groupBy(F.col("key").alias("bucket")).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    apart = scratch.keep(held.join(mixed, F.col("key") == F.col("bucket"), "left_semi").select("set").distinct(), "apart")
    rare = rare_shingles(hashes.join(apart, "set", "left_semi"), similar, scratch)
    done = pairs
    for turn in (0, 1, None):
        rest = scratch.keep(_meeting(rare, labels, similar, turn).join(done, ["a", "b"], "left_anti"), f"met-{turn}")
        if rest.isEmpty():
            if turn is None:
                break
            continue
        more = scratch.keep(_alike(rest, hashes, similar), f"alike-{turn}", texts=True)
        done, found = done.unionByName(rest), found.unionByName(more)
        labels = scratch.keep(connected_components(found, scratch, f"cc-{turn}"), f"labels-{turn}")
    grouped = scratch.keep(distinct.join(labels, F.col("set") == F.col("node"), "left").select("set", "first_doc", F.coalesce("component", "set").alias("component")), "grouped")
    least = grouped.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    of = scratch.keep(grouped.join(least, "component").select(F.col("set").alias("of"), "component_id"), "of")
    return sets.join(of, F.col("set") == F.col("of")).select("doc_id", "component_id")


def deduplicate(docs: DataFrame, shingle: int = 5, similar: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies, that of the smallest doc_id; same columns.

    What leaves is a table of doc_ids; Spark broadcasts it below its threshold and else shuffles the texts once.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    away = scratch.keep(near_copies(docs, scratch, shingle, similar).where("doc_id <> component_id").select(F.col("doc_id").alias("away_id")).distinct(), "away")
    scratch.leave("away")
    return docs.join(away, docs["doc_id"] == away["away_id"], "left_anti")
