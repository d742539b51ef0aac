"""Quality classification by hierarchical empirical Bayes.

A logistic classifier gives each document's own evidence: surface features of its text, and naive Bayes evidence of its
words and pairs of words, hashed. Grouped sums give every host and every
path of a host its posterior: a path's mean is shrunk toward its host's, a host's toward the global one, by
strengths fitted to the spread of paths within their hosts and of hosts (method of moments), so a sparse site says little. A document's
quality combines its own log odds with those of its path against the global prior; its own part is taken out of
its site first.

Training: at most about ``max_labels`` labelled documents, drawn by a hash of doc_id (a bounded sample, a
parameter). Half of them give the words' evidence, by sums made in Spark, the other half the classifier over it. Counts and
site statistics cover all documents.

Scale: texts are read where they are; only (doc_id, host, path, log odds) rows and per-site sums are shuffled. A hot
host is summed on the map side. Site tables are written, so that Spark knows their size and broadcasts them only
below its threshold; joins on a hot host beyond it can be split.

Edge cases: a text without words, null included, has quality 0 and is rejected. Null hosts and paths are sites of
their own, named by the empty string. Labels with null or without a document don't train; several labels of a document
count by their mean. If the labels don't hold both classes, every document with words has the prior's odds.
Repeated rows give repeated results. Extra columns of ``docs`` pass through ``keep_good``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm._shared import Scratch, short_batches, slices
from docquarry.llm.line_dedup import word_hashes

_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-?!()")
_STOPS = b".,;:'\"-?!()"
FEATURES = ["symbols", "stops", "exclaims", "digits", "upper", "word_length", "long_words", "distinct", "repeats", "line_words", "log_words", "words", "pairs", "one"]
#: Buckets of hashed words, and of pairs of words.
BUCKETS = 1 << 12
#: Lower-cases A-Z; ASCII that is no letter or digit becomes a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of the pairs of neighbouring words of a text in UTF-8."""
    plain = b" ".join(data.translate(_PLAIN).split())
    if not plain:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = word_hashes(plain)
    with np.errstate(over="ignore"):
        two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(52)).astype(np.int64), (two >> np.uint64(52)).astype(np.int64)


def features(text: str | None, evidence: np.ndarray) -> list[float] | None:
    """Of the whole text; None if it has no words. ``evidence``: log ratios of the buckets of words and of pairs."""
    words = text.split() if text else []
    if not words:
        return None
    data, n = text.encode("utf-8", "surrogatepass"), len(words)
    size = max(1, len(data) - data.count(b" ") - data.count(b"\n"))
    letters = max(1, len(re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b"", data)))
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        (len(data) - len(data.translate(None, _SYMBOLS))) / size,
        (len(data) - len(data.translate(None, _STOPS))) / size,
        data.count(b"!") / n,
        (len(data) - len(data.translate(None, b"0123456789"))) / size,
        (len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / letters,
        float(lengths.mean()),
        float((lengths > 8).mean()),
        len(set(words)) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        min(50.0, n / (1 + text.count("\n"))),
        float(np.log(n)),
        *(float(evidence[k][buckets].mean()) if len(buckets) else 0.0 for k, buckets in enumerate(hashed(data))),
        1.0,
    ]


class Classifier:
    """Logistic regression, fitted by Newton steps on standardised features, with the evidence these rest on."""

    def __init__(self, x: np.ndarray, y: np.ndarray, evidence: np.ndarray, ridge: float = 1.0):
        self.evidence = evidence
        k = len(FEATURES)
        self.mean, self.scale, self.w = np.zeros(k), np.ones(k), np.zeros(k)
        self.prior = float((y.sum() + 1) / (len(y) + 2))
        if len(y) == 0 or y.min() == y.max():
            self.w[-1] = np.log(self.prior / (1 - self.prior))
            return
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        self.mean[-1], self.scale[-1] = 0, 1
        z = (x - self.mean) / self.scale
        penalty = np.full(k, ridge)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.w)
            self.w += step
            if np.abs(step).max() < 1e-8:
                break

    def log_odds(self, text: str | None) -> float | None:
        """Null for a text without words."""
        if (x := features(text, self.evidence)) is None:
            return None
        return float(np.clip(((np.array(x) - self.mean) / self.scale) @ self.w, -15, 15))


def _featured(rows: DataFrame, out: T.StructType, make) -> DataFrame:
    """``rows`` (last column text) with what ``make`` gives for each text instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {"array<double>": pa.list_(pa.float64()), "double": pa.float64()}[out.fields[-1].dataType.simpleString()]
        for batch in slices(batches):
            made = [make(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, kind)], names=out.names)

    return rows.mapInArrow(run, out)


def mean_labels(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.avg(F.col("quality").cast("double")).alias("label"))


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000) -> Classifier:
    known = mean_labels(labels)
    share = min(1.0, max_labels / max(1, known.count()))
    drawn = known.where(F.shiftrightunsigned(F.xxhash64("label_id"), 11) / F.lit(float(1 << 53)) < share)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id"))  # bounded by max_labels
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # rows of an equal doc_id are one
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    evidence = _evidence(rows.where(half == 0).select("label", "text"))
    out = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    got = _featured(rows.where(half == 1).select("label", "text"), out, lambda t: features(t, evidence)).where("x is not null").collect()
    return Classifier(np.array([r.x for r in got]).reshape(len(got), len(FEATURES)), np.array([r.label for r in got]), evidence)


def _evidence(rows: DataFrame) -> np.ndarray:
    """Log ratios of the buckets' shares in good and in bad texts of ``rows(label, text)``: one row for words, one for pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2, BUCKETS))
        for batch in slices(batches):
            for label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, buckets in enumerate(hashed(text.encode("utf-8", "surrogatepass"))):
                    seen = np.bincount(buckets, minlength=BUCKETS) / max(1, len(buckets))  # a text counts once, however long
                    sums[1, k] += label * seen
                    sums[0, k] += (1 - label) * seen
        c, k, b = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(sums[c, k, b])], names=["c", "k", "b", "s"])

    found = rows.mapInArrow(count, "c int, k int, b int, s double").groupBy("c", "k", "b").agg(F.sum("s").alias("s")).toArrow()
    sums = np.zeros((2, 2, BUCKETS))
    sums[found["c"].to_numpy(), found["k"].to_numpy(), found["b"].to_numpy()] = found["s"].to_numpy()
    smooth = sums.sum(0) / max(1e-9, sums.sum() / 2) + 1 / BUCKETS  # rare buckets say little
    share = (sums + smooth) / (sums + smooth).sum(2, keepdims=True)
    return np.log(share[1] / share[0]).astype(np.float32)


def log_odds(docs: DataFrame, model: Classifier, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, own): own is the document's log odds by its text, null without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "text")
    out = T.StructType([rows.schema["doc_id"], T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("own", T.DoubleType())])
    return _featured(rows, out, lambda t: shared.value.log_odds(t))


def _strength(sites: DataFrame) -> float:
    """Prior observations worth of the spread of the means of sites (n, s) around those of what they belong to (m)."""
    spread, noise = F.pow(F.col("s") / F.col("n") - F.col("m"), 2), F.col("m") * (1 - F.col("m"))
    r = sites.where("n > 1").agg(F.sum("n").alias("n"), F.sum(F.col("n") * spread).alias("ss"), F.sum(noise).alias("expected"), F.sum(F.col("n") * noise).alias("noise")).first()
    if not r.n or not r.noise:
        return 10.0
    within = r.noise / r.n
    between = max((r.ss - r.expected) / r.n, within / 10_000)
    return float(min(max(within / between - 1, 0.5), 10_000))


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.3, max_labels: int = 20_000, scratch: Scratch | None = None) -> DataFrame:
    """Per row: doc_id, host, path, p_doc, host_posterior, path_posterior, quality, keep."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    with short_batches(docs.sparkSession):
        model = fit(docs, labels, max_labels)
    own = log_odds(docs, model, host, path)
    known = mean_labels(labels)
    # a labelled document counts for its site by its label, any other by the classifier
    rows = scratch.keep(
        own.join(known, F.col("doc_id") == F.col("label_id"), "left").select("doc_id", "host", "path", "own", F.coalesce("label", 1 / (1 + F.exp(-F.col("own"))), F.lit(0.0)).alias("y")), "rows", texts=True
    )
    paths = scratch.keep(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("s")), "paths")
    hosts = scratch.keep(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(total.s / total.n) if total.n else 0.5
    of_host = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    sites = scratch.keep(
        paths.join(of_host, F.col("host") == F.col("h")).select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "host_n", "host_s", F.col("n").alias("path_n"), F.col("s").alias("path_s")), "sites"
    )
    at_host = _strength(hosts.withColumn("m", F.lit(mean)))
    at_path = _strength(sites.select(F.col("path_n").alias("n"), F.col("path_s").alias("s"), (F.col("host_s") / F.col("host_n")).alias("m")))
    odds = lambda p: F.log(p / (1 - p))
    clip = lambda p: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    joined = rows.join(sites, (F.col("host") == F.col("site_host")) & (F.col("path") == F.col("site_path")))
    joined = joined.withColumn("host_posterior", (F.col("host_s") - F.col("y") + at_host * mean) / (F.col("host_n") - 1 + at_host))
    joined = joined.withColumn("path_posterior", clip((F.col("path_s") - F.col("y") + at_path * F.col("host_posterior")) / (F.col("path_n") - 1 + at_path)))
    quality = F.when(F.col("own").isNull(), 0.0).otherwise(1 / (1 + F.exp(-(F.col("own") + odds(F.col("path_posterior")) - odds(clip(F.lit(mean)))))))
    return joined.withColumn("quality", quality).select(
        "doc_id", "host", "path", F.coalesce(1 / (1 + F.exp(-F.col("own"))), F.lit(0.0)).alias("p_doc"), "host_posterior", "path_posterior", "quality", (F.col("quality") >= threshold).alias("keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rejected; same columns. Rows of equal doc_id go if any of them is rejected."""
    scratch = Scratch(docs.sparkSession, "quality")
    bad = scratch.keep(score(docs, labels, host, path, threshold, scratch=scratch).where(~F.col("keep")).select(F.col("doc_id").alias("bad_id")).distinct(), "ids")
    scratch.leave("ids")
    return docs.join(bad, docs["doc_id"] == bad["bad_id"], "left_anti")
