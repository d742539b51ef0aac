"""Answers that need a small Python helper: literals, normalised spans, list scores by best assignment."""

from __future__ import annotations

import ast
import math
import re
import string
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_items(text: str | None) -> list[str] | None:
    """The items of a Python literal as texts: a list, tuple or set; of a list of mappings, their values joined by "-".
    Anything else is one item; null and empty text have none."""
    if text is None or text == "":
        return []
    try:
        value = ast.literal_eval(text.strip())
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return [text]
    items = list(value) if isinstance(value, list | tuple | set) else [value]
    if items and isinstance(items[0], dict):
        items = ["-".join(map(str, x.values())) if isinstance(x, dict) else x for x in items]
    return [str(x) for x in items]


@F.pandas_udf(T.ArrayType(T.StringType()))
def literal_items(text: pd.Series) -> pd.Series:
    return text.map(parse_items)


#: Number words.
UNITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
LARGE = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9}
NUMBER_WORDS = {w: i for i, w in enumerate(UNITS)} | {w: 10 * i for i, w in enumerate(TENS, 2)} | LARGE
_NO_PUNCTUATION = str.maketrans("", "", string.punctuation)
_ARTICLE = re.compile(r"\b(a|an|the)\b")


def as_number(word: str) -> float | None:
    try:
        return float(word)
    except ValueError:
        return None


def normalized_span(text: str) -> str:
    """Words cut at spaces and hyphens, lower case; numbers, written out or not, as floats; others without punctuation and articles."""
    out = []
    for word in re.split("[ -]", text):
        word = word.lower()
        if as_number(word) is None:
            word = word.translate(_NO_PUNCTUATION)
        value = as_number(word)
        if value is None and word.strip() in NUMBER_WORDS:
            value = float(NUMBER_WORDS[word.strip()])
        out += (_ARTICLE.sub(" ", word) if value is None else str(value)).split()
    return " ".join(out)


def bag_f1(gold: set[str], pred: set[str]) -> float:
    """F1 of two sets of words; 0 where gold has numbers and the prediction none of them. An empty set costs nothing on its side."""
    numbers = {w for w in gold if as_number(w) is not None}
    if numbers and not numbers & pred:
        return 0.0
    both = len(gold & pred)
    p, r = both / len(pred) if pred else 1.0, both / len(gold) if gold else 1.0
    return 2 * p * r / (p + r) if p + r else 0.0


def best_assignment(scores: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest total, each used once: shortest augmenting paths with potentials."""
    n, m = len(scores), len(scores[0]) if scores else 0
    if n > m:
        return [(r, c) for c, r in best_assignment([list(x) for x in zip(*scores, strict=True)])]
    u, v, owner = [0.0] * n, [0.0] * m, [-1] * m
    for row in range(n):
        far, back, done = [math.inf] * m, [-1] * m, [False] * m
        at, column = row, -1
        while True:
            least, nxt = math.inf, -1
            for c in range(m):
                if not done[c]:
                    if (d := -scores[at][c] - u[at] - v[c]) < far[c]:
                        far[c], back[c] = d, column
                    if far[c] < least:
                        least, nxt = far[c], c
            u[row] += least
            for c in range(m):
                if done[c]:
                    u[owner[c]] += least
                    v[c] -= least
                else:
                    far[c] -= least
            column, done[nxt] = nxt, True
            if owner[nxt] < 0:
                break
            at = owner[nxt]
        while column >= 0:
            owner[column] = row if back[column] < 0 else owner[back[column]]
            column = back[column]
    return [(r, c) for c, r in enumerate(owner) if r >= 0]


def list_em(gold: list[str], pred: list[str]) -> float:
    """1 if the normalised spans are the same ones and as many."""
    g, p = (list(map(normalized_span, x)) for x in (gold, pred))
    return float(set(g) == set(p) and len(g) == len(p))


def list_f1(gold: list[str], pred: list[str]) -> float:
    """Mean F1 over the longer list's length of spans aligned for the best total, to two digits."""
    g, p = ([set(normalized_span(s).split()) for s in x] for x in (gold, pred))
    if not g or not p:
        return 0.0
    scores = [[bag_f1(a, b) for b in p] for a in g]
    return round(sum(scores[r][c] for r, c in best_assignment(scores)) / max(len(g), len(p)), 2)


def _of_lists(score: Callable[[list[str], list[str]], float], gold: pd.Series, pred: pd.Series) -> pd.Series:
    spans = lambda x: ["" if s is None else s for s in x]
    return pd.Series([None if g is None or p is None else score(spans(g), spans(p)) for g, p in zip(gold, pred, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def list_em_score(gold: pd.Series, pred: pd.Series) -> pd.Series:
    """``list_em``; null if either list is null. A null span is an empty one."""
    return _of_lists(list_em, gold, pred)


@F.pandas_udf(T.DoubleType())
def list_f1_score(gold: pd.Series, pred: pd.Series) -> pd.Series:
    """``list_f1``; null if either list is null. A null span is an empty one."""
    return _of_lists(list_f1, gold, pred)


@F.pandas_udf(T.StringType())
def normalized(text: pd.Series) -> pd.Series:
    return text.map(normalized_span, na_action="ignore")


def visited_text(node: object, keys: tuple[str, ...], out: list[str]) -> None:
    """Texts of nested lists and of the named fields of mappings, depth first, the fields in the order of ``keys``."""
    if isinstance(node, str):
        if text := " ".join(node.split(" ")).strip():
            out.append(text)
    elif isinstance(node, list):
        for x in node:
            visited_text(x, keys, out)
    elif isinstance(node, dict):
        for k in keys:
            if k in node:
                visited_text(node[k], keys, out)


#: The fields of a parsed block that hold text.
TEXT_KEYS = ("text", "content", "caption", "title", "md_content")


@F.pandas_udf(T.StringType())
def flattened_json(text: pd.Series) -> pd.Series:
    """All texts of nested JSON, one a line; empty for what is no JSON."""
    import json

    def one(s: str | None) -> str:
        out: list[str] = []
        try:
            visited_text(json.loads(s or "null"), TEXT_KEYS, out)
        except ValueError:
            return ""
        return "\n".join(out)

    return text.map(one)


@F.pandas_udf(T.StringType())
def repaired_json(text: pd.Series) -> pd.Series:
    """The JSON object of a model's answer, mended where it is broken; null if there is none."""
    return text.map(repair_json, na_action="ignore")


def _object_text(text: str) -> str | None:
    """What lies between the tags, inside a fence, from the first brace to the last."""
    tagged = re.search(r"<dag>(.*?)</dag>", text, re.S)
    body = tagged.group(1) if tagged else text
    fence = re.search(r"```(?:json)?(.*?)```", body, re.S | re.I)
    body = fence.group(1) if fence else body
    a, b = body.find("{"), body.rfind("}")
    return body[a : b + 1] if 0 <= a < b else None


def repair_json(text: str) -> str | None:
    """Compact JSON. Mends commas before a closing bracket, raw line breaks inside strings, and quotes inside strings: a quote
    ends a string only if what follows it can follow a string."""
    import json

    if (body := _object_text(text)) is None:
        return None
    for tried in (body, _mended(body)):
        try:
            return json.dumps(json.loads(tried), separators=(",", ":"))
        except ValueError:
            continue
    return None


def _mended(body: str) -> str:
    breaks = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
    out, inside = [], False
    for part in re.finditer(r'\\.|"|[^"\\]+', body, re.S):
        piece = part.group()
        if piece == '"':
            if inside and not re.match(r'\s*(?:[}\]:]|$|,\s*["{\[}\]\d-])', body[part.end() :]):
                piece = '\\"'
            else:
                inside = not inside
        elif inside and piece[0] != "\\":
            piece = "".join(breaks.get(c, c) for c in piece)
        elif not inside:
            piece = re.sub(r",\s*$", ",", piece)
        out.append(piece)
    return re.sub(r",(\s*[}\]])", r"\1", "".join(out))


#: Marks that are taken out of an answer, in this order.
VQA_MARKS = (";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!")


def vqa_clean(text: Column) -> Column:
    """An answer for comparison: line breaks and tabs as spaces; marks dropped where one stands beside a space or the text has a
    number with commas, else a space instead; points that no digit follows dropped; lower case; number words up to ten as
    digits, articles dropped. Contractions stay as they are."""
    bare = F.btrim(F.translate(text, "\n\t", "  "))

    def without(t: Column, mark: Column) -> Column:
        apart = F.contains(t, F.concat(mark, F.lit(" "))) | F.contains(t, F.concat(F.lit(" "), mark)) | F.rlike(t, F.lit(r"\d,\d"))
        return F.replace(t, mark, F.when(apart, "").otherwise(" "))

    marked = F.aggregate(F.array(*map(F.lit, VQA_MARKS)), bare, without)
    words = F.filter(F.split(F.lower(F.regexp_replace(marked, r"\.(?!\d)", "")), r"\s+"), lambda w: (w != "") & ~w.isin("a", "an", "the"))
    digits = F.create_map(*[F.lit(x) for i, w in enumerate(("none", *UNITS[1:11])) for x in (w, str(i))], F.lit("zero"), F.lit("0"))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(digits, w), w)), " ")


def vqa_correct(kind: Column, answer: Column, golds: Column) -> Column:
    """Whether an answer is right by the rules of its dataset: any gold answer once a per cent sign only one side has is
    dropped; for numbers (kind "number") within 5 % of a gold that isn't 0; for choices the first letter."""
    def near(a: Column, g: Column) -> Column:
        x, y = a.try_cast("double"), g.try_cast("double")
        return F.coalesce((kind == "number") & (y != 0) & (F.abs((x - y) / y) <= 0.05), F.lit(False))

    def of(r: Column) -> Column:
        sign = F.contains(F.get(r["g"], F.lit(0)), F.lit("%"))
        a = F.when(sign, r["a"]).otherwise(F.replace(r["a"], F.lit("%"), F.lit("")))
        bare = F.contains(r["a"], F.lit("%"))
        g = F.transform(r["g"], lambda x: F.when(bare, x).otherwise(F.replace(x, F.lit("%"), F.lit(""))))
        return F.exists(g, lambda x: (x == a) | near(a, x))

    from docquarry.functions.scoring import let

    words = let({"a": vqa_clean(answer), "g": F.transform(golds, vqa_clean)}, of)
    return F.when(kind == "choice", F.upper(F.left(answer, F.lit(1))) == F.upper(F.left(F.get(golds, F.lit(0)), F.lit(1)))).otherwise(words)
