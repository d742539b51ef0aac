"""Answer scoring: string similarity, tolerant numbers, lists, token F1, rewards, buckets.

Two benchmarks clean strings differently; ``clean_m`` and ``clean_l`` keep the order of their steps, which matters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(values: dict[str, Column], f: Callable[[Column], Column]) -> Column:
    """``f`` of a struct of the values, each computed once: an expression that is used many times would be copied."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f), F.lit(0))


def anls(gold: Column, pred: Column, threshold: float = 0.5) -> Column:
    """1 - edit distance over the longer length; at or below the threshold 0; both empty 1."""

    def of(r: Column) -> Column:
        longer = F.greatest(F.length(r["g"]), F.length(r["p"]))
        return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(r["g"], r["p"]) / longer)

    return let({"s": let({"g": gold, "p": pred}, of)}, lambda r: F.when(r["s"] <= threshold, 0.0).otherwise(r["s"]))


def decimals(value: Column) -> Column:
    """Digits after the point of a number as it is written; 3 without a point."""
    text = value.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.length(F.substring_index(text, ".", -1))).otherwise(3)


def plain_number(text: Column) -> Column:
    """The number of a text that may end in a per cent sign; null if it is none."""
    return F.regexp_replace(F.btrim(text), r"[%\s]+$", "").try_cast("double")


def float_equal(gold: Column, pred: Column) -> Column:
    """Texts that are equal as numbers, gold taken as such, as a hundredth or a hundredfold: within 1 % of the larger,
    or after rounding to the fewer digits of the two, 2 at least. Null if either is no number."""

    def near(x: Column, b: Column) -> Column:
        scale = F.pow(F.lit(10.0), F.greatest(F.least(decimals(b), decimals(x)), F.lit(2)))
        return (F.abs(x - b) <= 0.01 * F.greatest(F.abs(x), F.abs(b))) | (F.rint(x * scale) == F.rint(b * scale))

    def any_near(r: Column) -> Column:
        return F.when(r["a"].isNotNull() & r["b"].isNotNull(), F.exists(F.array(r["a"] / 100, r["a"], r["a"] * 100), lambda x: near(x, r["b"])))

    return let({"a": plain_number(gold), "b": plain_number(pred)}, any_near)


#: Answers of these forms are compared exactly.
EXACT_PATTERNS = ("https://", r"(\.py|ipynb)$", "^page", r"^\d+(-\d+|\s\d+)?$", r"[ap]\.m\.", r"^\d{4}[-\s]\d{2}[-\s]\d{2}$", r"^\d{4}[-\s]\d{2}$", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")


def exact_match_form(text: Column) -> Column:
    return reduce(lambda u, v: u | v, [F.rlike(text, F.lit(p)) for p in EXACT_PATTERNS])


def float_like(text: Column) -> Column:
    return F.btrim(text).try_cast("double").isNotNull()


def _without_suffixes(text: Column, suffixes: tuple[str, ...]) -> Column:
    """A trimmed text with each suffix in turn taken off its end."""
    for s in suffixes:
        text = F.btrim(F.regexp_replace(text, s + "$", ""))
    return text


#: Unit words each benchmark strips from the end of an answer, in this order.
SUFFIXES_M = ("mile", "miles", "million")
SUFFIXES_L = ("kg", "mm", "m", "meters", "acres", "minutes", "mile", "miles", "million", "thousand", "billion")


def _bare(text: Column, currencies: str) -> Column:
    """Without parentheses, outer quotes, leading currency signs and trailing per cent signs."""
    text = F.btrim(F.regexp_replace(text, r"\s*\([^)]*\)", ""))
    text = F.btrim(F.regexp_replace(text, r"""^['"]|['"]$""", ""))
    for sign in currencies:
        text = F.btrim(F.ltrim(text, F.lit(sign)))
    return F.btrim(F.rtrim(text, F.lit("%")))


def clean_m(text: Column) -> Column:
    return _bare(_without_suffixes(F.btrim(F.lower(text)), SUFFIXES_M), "$")


def clean_l(text: Column) -> Column:
    return _bare(_without_suffixes(F.replace(F.btrim(F.lower(text)), F.lit(","), F.lit("")), SUFFIXES_L), "$£")


def _words_score(g: Column, p: Column) -> Column:
    return F.when(exact_match_form(g), (g == p).cast("double")).otherwise(anls(g, p))


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def score_m(gold: Column, pred: Column, kind: Column) -> Column:
    """Score of a single answer by its format Int, Float or text. Null for Float where gold is no number."""
    whole = lambda x: x.try_cast("double").cast("bigint")

    def of(r: Column) -> Column:
        real = F.when(plain_number(r["g"]).isNotNull(), _yes(float_equal(r["g"], r["p"])))
        return F.when(r["k"] == "Int", _yes(whole(r["g"]) == whole(r["p"]))).when(r["k"] == "Float", real).otherwise(_words_score(r["g"], r["p"]))

    return let({"g": clean_m(gold), "p": clean_m(pred), "k": kind}, of)


def score_l(gold: Column, pred: Column, kind: Column) -> Column:
    """Score of a single answer by its format Integer, Float or text; what should be a number and isn't scores 0."""

    def of(r: Column) -> Column:
        whole = _yes(r["g"].try_cast("bigint") == r["p"].try_cast("bigint"))
        return F.when(r["k"] == "Integer", whole).when(r["k"] == "Float", _yes(float_equal(r["g"], r["p"]))).otherwise(_words_score(r["g"], r["p"]))

    return let({"g": clean_l(gold), "p": clean_l(pred), "k": kind}, of)


def clean_list_item(text: Column) -> Column:
    """An item of a list answer: per cent wording as a sign, households dropped, then cleaned."""
    text = F.regexp_replace(F.btrim(F.lower(text)), r"\bpercentage\s+points?\b|\bpercent(age)?\b", "%")
    text = F.btrim(F.regexp_replace(text, r"\s+", " "))
    text = F.regexp_replace(text, r"(\d+(?:\.\d+)?)\s*%", "$1%")
    return clean_m(F.btrim(F.regexp_replace(text, r"\s+households?\b", "")))


def _exact_list(g: Column) -> Column:
    first = F.get(g, F.lit(0))
    return float_like(first) | exact_match_form(first)


def list_score_m(gold: Column, pred: Column) -> Column:
    """Lists of equal length, sorted: exact if the first gold item asks for it, else the worst pair's similarity."""

    def of(r: Column) -> Column:
        g, p = r["g"], r["p"]
        worst = F.array_min(F.zip_with(g, p, lambda a, b: anls(a, b)))
        return F.when((F.size(g) != F.size(p)) | (F.size(g) == 0), 0.0).when(_exact_list(g), (F.array_join(g, "-") == F.array_join(p, "-")).cast("double")).otherwise(worst)

    return let({"g": F.array_sort(F.transform(gold, clean_list_item)), "p": F.array_sort(F.transform(pred, clean_list_item))}, of)


def list_score_l(gold: Column, pred: Column) -> Column:
    """Exact and in order if the first gold item asks for it; else the mean over gold items of their best similarity,
    times the root of min(1, gold size / predicted size)."""

    def of(r: Column) -> Column:
        g, p = r["g"], r["p"]
        best = F.transform(g, lambda a: F.coalesce(F.array_max(F.transform(p, lambda b: anls(a, b))), F.lit(0.0)))
        mean = F.aggregate(best, F.lit(0.0), lambda acc, x: acc + x) / F.size(g)
        fuzzy = mean * F.sqrt(F.least(F.lit(1.0), F.size(g) / F.size(p)))
        return F.when((F.size(g) == 0) | (F.size(p) == 0), 0.0).when(_exact_list(g), (F.array_join(g, "-") == F.array_join(p, "-")).cast("double")).otherwise(fuzzy)

    return let({"g": F.transform(gold, clean_l), "p": F.transform(pred, clean_l)}, of)


def qa_tokens(text: Column) -> Column:
    """Lower case, punctuation and articles dropped, split at white space."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", ""), r"\b(a|an|the)\b", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: t != "")


def set_f1(gold: Column, pred: Column) -> Column:
    """F1 of the sets of tokens."""
    g, p = F.array_distinct(qa_tokens(gold)), F.array_distinct(qa_tokens(pred))
    common = F.size(F.array_intersect(g, p))
    return F.when(common == 0, 0.0).otherwise(2 * common / (F.size(g) + F.size(p)))


def contains_answer(gold: Column, pred: Column) -> Column:
    return F.contains(F.array_join(qa_tokens(pred), " "), F.array_join(qa_tokens(gold), " "))


def length_penalty(length: Column, soft: int, hard: int) -> Column:
    """0 up to ``soft``, falling to -1 at ``hard`` and beyond."""
    return F.when(length <= soft, 0.0).when(length >= hard, -1.0).otherwise((soft - length) / (hard - soft))


def tagged(text: Column, tag: str) -> Column:
    """What stands between the first pair of tags; empty without one."""
    return F.btrim(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1))


def last_answer(text: Column) -> Column:
    """What follows the last ``Answer:`` of a line."""
    return F.btrim(F.regexp_extract(text, r"(?is)^.*\banswer\s*:\s*([^\n]*)", 1))


def score_bucket(score: Column) -> Column:
    return F.when(score >= 0.999, "correct").when(score <= 0.001, "wrong").otherwise("partial")


def display_score(corrected: Column, metadata: Column, score: Column) -> Column:
    """The corrected score, else that of the metadata, else the score; what is no number is 0."""
    return F.coalesce(corrected.try_cast("double"), metadata.try_cast("double"), score.try_cast("double"), F.lit(0.0))


#: What a correction from one bucket to another is called, by the direction of its score.
OUTCOMES = {
    ("wrong", "up", "correct"): "wrong_to_correct",
    ("wrong", "up", "wrong"): "wrong_to_wrong",
    ("wrong", "down", "wrong"): "wrong_to_wrong",
    ("wrong", "same", "wrong"): "wrong_to_wrong",
    ("wrong", "up", "partial"): "improved_partial",
    ("partial", "up", "partial"): "improved_partial",
    ("partial", "down", "partial"): "regressed",
    ("partial", "down", "wrong"): "regressed",
}


def correction_outcome(tried: Column, error: Column, before: Column, after: Column, final: Column) -> Column:
    """What a correction did, by ``OUTCOMES``; one without a score failed, one that changes nothing isn't applied or leaves
    the answer unchanged, and right answers are not corrected."""
    way = F.when(after > before, "up").when(after < before, "down").otherwise("same")
    told = F.create_map(*[F.lit(x) for (b, w, a), name in OUTCOMES.items() for x in (f"{b} {w} {a}", name)])
    changed = F.try_element_at(told, F.concat_ws(" ", score_bucket(before), way, score_bucket(after)))
    none = F.when(final.isNotNull() & (after != final), "not_applied").otherwise("unchanged")
    failed = F.when(error.isNotNull() | (before.isNotNull() & after.isNull()), "correction_error")
    early = F.when(~F.coalesce(tried, F.lit(False)), "not_run").when(error.isNull() & (before >= 0.999), "skipped_initial_correct").when(error.isNull() & before.isNull(), "not_run")
    return F.coalesce(early, failed, changed, none)


def crop_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Pixel box of a box in thousandths, padded by 6 % of its sides (8 px at least) and clipped; null if it is
    turned around or a side has under 20 px."""
    at = lambda v, size: F.rint(v / 1000 * size).cast("int")
    left, top, right, bottom = at(x0, width), at(y0, height), at(x1, width), at(y1, height)
    px, py = (F.greatest(F.lit(8), F.floor((b - a) * 0.06).cast("int")) for a, b in ((left, right), (top, bottom)))
    box = [F.greatest(F.lit(0), left - px), F.greatest(F.lit(0), top - py), F.least(width, right + px), F.least(height, bottom + py)]
    return F.when((right > left) & (bottom > top) & (box[2] - box[0] >= 20) & (box[3] - box[1] >= 20), F.array(*box))
