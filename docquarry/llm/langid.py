"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier over hashed character trigrams predicts each bit, and the
language whose codeword loses least, bits weighted by how well they did in training, is the answer. A small lead
over the second is flagged as ambiguous.

Training: at most about ``per_language`` documents of each language, drawn by a hash of doc_id (a bounded sample of labelled
rows, a parameter). The trigram counts of four fifths are summed in Spark, by language and then by bit: each language counts with
its shares on its side of a bit. So every language of the table is learned, and what reaches the driver is ``BUCKETS`` numbers a
bit, of which there are about 15 log2 of the number of languages. The rest of the sample tells how far each bit can be trusted.

Scale: training reads a sample, prediction is a map without a shuffle over whole texts.

Edge cases: null text or one without a letter is ``und`` with score 0. Rows without lang or doc_id don't train. With
no labelled document every text is ``und``. A repeated row gives a repeated result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm._shared import slices, without

BUCKETS = 1 << 14
_LETTERS = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def trigrams(text: str) -> np.ndarray:
    """Bucket of each byte trigram of the lower-cased text; runs of what isn't a letter count as one space."""
    data = b" ".join([b"", *text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split(), b""])
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    code = (b[:-2] << 16) + (b[1:-1] << 8) + b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(18)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` codewords of -1 and 1: all ways to part few languages in two; for many, the best of seeded draws."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        cuts = np.arange(1, 2 ** (n - 1))
        return np.where((cuts[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    rng, bits, best, most = np.random.default_rng(seed), 15 * int(np.ceil(np.log2(n))), None, -1
    for _ in range(max(1, min(200, 200 * 512**2 // n**2))):
        code = np.where(rng.permuted(np.tile(np.arange(n) < n // 2, (bits, 1)), axis=1).T, 1.0, -1.0)
        least = bits
        for a in range(0, n, 1024):
            apart = (bits - code[a : a + 1024] @ code.T) / 2
            apart[np.arange(len(apart)), np.arange(a, a + len(apart))] = bits
            least = min(least, int(apart.min()))
        if least > most:
            best, most = code, least
    return best


class Model:
    """Languages, codewords (languages x bits), weights (buckets x bits), and weights of the bits."""

    def __init__(self, languages: list[str], shares: np.ndarray | None = None):
        """``shares`` (bits x 2 x buckets): mean share of each bucket in the languages of either side of a bit."""
        self.languages, self.code = languages, codewords(len(languages))
        bits = self.code.shape[1]
        self.weights = np.zeros((BUCKETS, bits), np.float32)
        if shares is not None:
            two_sided = (self.code > 0).any(0) & (self.code < 0).any(0)
            self.weights[:, two_sided] = (np.log(shares[two_sided, 0]) - np.log(shares[two_sided, 1])).T
        self.trust = np.ones(bits)

    def margins(self, text: str) -> np.ndarray:
        """Mean evidence of each bit, times the number of trigrams up to 64."""
        grams, total = trigrams(text), np.zeros(self.code.shape[1])
        for i in range(0, len(grams), 100_000):
            total += self.weights[grams[i : i + 100_000]].sum(0, dtype=np.float64)
        return total / max(1, len(grams)) * min(64, len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        m = self.margins(text)
        right, wrong = np.logaddexp(0, -m) * self.trust, np.logaddexp(0, m) * self.trust
        loss = (np.where(self.code > 0, right, wrong)).sum(1) / self.trust.sum()
        order = np.argsort(loss, kind="stable")
        lead = loss[order[1]] - loss[order[0]] if len(order) > 1 else 50.0
        return self.languages[order[0]], float(1 / (1 + np.exp(-lead)))


def fit(docs: DataFrame, usable: Column, per_language: int = 3000, smooth: float = 0.5) -> Model:
    """Learns from text and lang of the rows of ``docs`` where ``usable`` holds and lang is not null."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = rows.groupBy(F.col("lang").alias("of_lang")).agg((per_language / F.count("*")).alias("share"))
    languages = sorted(r.of_lang for r in sizes.collect())
    if not languages:
        return Model([])
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53)) < F.col("share")
    place, last = {x: i for i, x in enumerate(languages)}, F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) == 4
    # a row a language, as the model has, so that no text is shuffled
    sample = rows.join(F.broadcast(sizes), F.col("lang") == F.col("of_lang")).where(drawn)
    code = codewords(len(languages))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            found = [(i, np.flatnonzero(c)) for i, c in counts.items()]
            lang = np.concatenate([np.full(len(g), i, np.int32) for i, g in found])
            return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(np.concatenate([g for _, g in found]).astype(np.int32)), pa.array(np.concatenate([counts[i][g] for i, g in found]))], names=["l", "g", "n"])

        for batch in slices(batches):
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = counts.setdefault(place[lang], np.zeros(BUCKETS, np.int64))
                held += np.bincount(trigrams(text), minlength=BUCKETS)
            if len(counts) > 512:  # so many tables at a time
                yield out()
                counts.clear()
        if counts:
            yield out()

    found = sample.where(~last).select("lang", "text").mapInArrow(count, "l int, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    totals = found.groupBy(F.col("l").alias("of")).agg(F.sum("n").alias("total"))
    weighed = found.join(totals, F.col("l") == F.col("of")).select("l", "g", (F.col("n") / (F.col("total") + smooth * BUCKETS)).alias("part"))

    def side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((code.shape[1], 2, BUCKETS))
        for batch in slices(batches, 8192):
            lang, g, part = (c.to_numpy() for c in batch.columns)
            for bit in range(len(sums)):
                one = code[lang, bit] > 0
                sums[bit, 0] += np.bincount(g[one], part[one], BUCKETS)
                sums[bit, 1] += np.bincount(g[~one], part[~one], BUCKETS)
        for bit in range(len(sums)):
            for s in (0, 1):
                g = np.flatnonzero(sums[bit, s])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), bit, np.int32)), pa.array(np.full(len(g), s, np.int32)), pa.array(g.astype(np.int32)), pa.array(sums[bit, s, g])], names=["bit", "side", "g", "part"])

    got = weighed.mapInArrow(side, "bit int, side int, g int, part double").groupBy("bit", "side", "g").agg(F.sum("part").alias("part")).toArrow()
    # a bucket that a language doesn't have counts with the smoothing's share
    base = np.full(len(languages), smooth / (smooth * BUCKETS))
    for r in totals.collect():
        base[r.of] = smooth / (r.total + smooth * BUCKETS)
    shares = np.stack([np.where(code > 0, base[:, None], 0).sum(0), np.where(code < 0, base[:, None], 0).sum(0)], axis=1)[:, :, None] * np.ones(BUCKETS)
    np.add.at(shares, tuple(got[c].to_numpy() for c in ("bit", "side", "g")), got["part"].to_numpy())
    shares /= np.maximum(1, np.stack([(code > 0).sum(0), (code < 0).sum(0)], axis=1))[:, :, None]
    model = Model(languages, shares)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, n = np.zeros(model.code.shape[1], np.int64), 0
        for batch in slices(batches):
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                right += model.margins(text) * model.code[place[lang]] > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(right), dtype=np.int32)), pa.array(right), pa.array([n] * len(right), pa.int64())], names=["bit", "good", "n"])

    good = sample.where(last).select("lang", "text").mapInArrow(judge, "bit int, good long, n long").groupBy("bit").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect()
    for r in good:
        rate = (r.good + 1) / (r.n + 2)
        model.trust[r.bit] = max(0.05, np.log(rate / (1 - rate)))
    return model


def predict(docs: DataFrame, model: Model, ambiguous_below: float = 0.7) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous; input columns of these names are replaced."""
    added = ["lang_pred", "score", "ambiguous"]
    kept = docs.select(*without(docs, *added))
    at, shared = kept.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [shared.value.predict(t) for t in batch.column(at).to_pylist()]
            score = [s for _, s in got]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array(score, pa.float64()), pa.array([s < ambiguous_below for s in score], pa.bool_())], names=[*batch.schema.names, *added]
            )

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True where crc32 of the id as text is divisible by ``folds``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, per_language: int = 3000) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, ambiguous; learned from the rows that aren't held out."""
    model = fit(docs, ~held_out(), per_language)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
