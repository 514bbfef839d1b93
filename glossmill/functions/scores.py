"""Similarity scores: Columns, and Arrow-batched n-gram scores of pairs of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from glossmill.functions.text import strip, tokens

CHRF_ORDER, CHRF_BETA = 6, 2.0


def memory_score(query: Column, text: Column) -> Column:
    """Raw score of a memory entry: 1 if equal, else by how much of it the query covers, else a
    quarter of the token Jaccard; 0 where either is blank. It is not symmetric."""
    q, t = F.lower(strip(query)), F.lower(strip(text))
    a, b = F.array_distinct(tokens(q)), F.array_distinct(tokens(t))
    union = F.size(F.array_union(a, b))
    overlap = F.when(union == 0, F.lit(0.0)).otherwise(F.lit(0.25) * F.size(F.array_intersect(a, b)) / union)
    inside = F.least(F.lit(0.95), F.lit(0.6) + F.lit(0.35) * F.length(q) / F.length(t))
    return F.when((q == "") | (t == "") | q.isNull() | t.isNull(), F.lit(0.0)).when(q == t, F.lit(1.0)).when(F.contains(t, q), inside).otherwise(overlap)


def rounded(score: Column) -> Column:
    """To four digits, halves to the even one."""
    return F.rint(score * 1e4) / 1e4


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v)) + 1e-12
    return F.transform(v, lambda x: x.cast("double") / norm)


def shared_grams(a: str, b: str, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 .. order, counts of each character n-gram in both texts. An n-gram is numbered by
    the number of its first n - 1 characters and its last one, so counts are exact."""
    points = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, chars = np.unique(points, return_inverse=True)
    ids = chars
    for n in range(1, order + 1):
        if n > 1:
            if len(ids) < 2:
                ids = ids[:0]
            else:
                ids = np.unique(ids[:-1].astype(np.int64) * len(kinds) + chars[n - 1 :], return_inverse=True)[1]
        top = int(ids.max()) + 1 if len(ids) else 0
        first = ids[: max(len(a) - n + 1, 0)]
        second = ids[len(a) :] if len(b) >= n else ids[:0]
        yield np.bincount(first, minlength=top), np.bincount(second, minlength=top)


def chrf_score(hyp: str, ref: str, order: int = CHRF_ORDER, beta: float = CHRF_BETA) -> float:
    """Character n-gram F-score in 0..1 of hyp against ref, white space left out; precision and
    recall are means over the orders for which both texts have n-grams."""
    p = q = 0.0
    n = 0
    for h, r in shared_grams(re.sub(r"\s+", "", hyp), re.sub(r"\s+", "", ref), order):
        if h.any() and r.any():
            same = float(np.minimum(h, r).sum())
            p, q, n = p + same / int(h.sum()), q + same / int(r.sum()), n + 1
    if not n or p + q == 0:
        return 0.0
    p, q, b = p / n, q / n, beta * beta
    return (1 + b) * p * q / (b * p + q)


def trigram_similarity(a: str, b: str) -> float:
    """Cosine of the counts of character trigrams; 1 for equal texts."""
    if a == b:
        return 1.0
    *_, (x, y) = shared_grams(a, b, 3)
    xx, yy = int((x * x).sum()), int((y * y).sum())
    return float(int((x * y).sum()) / np.sqrt(float(xx) * float(yy))) if xx and yy else 0.0


@F.pandas_udf(StructType([StructField("chrf", DoubleType()), StructField("similarity", DoubleType())]))
def text_scores(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """Both scores of pairs of texts, 0 where one is null. Counting n-grams inside a batch keeps
    the n-grams, six for each character, out of any shuffle."""
    pairs = [(h, r) if h is not None and r is not None else None for h, r in zip(hyp, ref, strict=True)]
    return pd.DataFrame({"chrf": [chrf_score(*p) if p else 0.0 for p in pairs], "similarity": [trigram_similarity(*p) if p else 0.0 for p in pairs]})


def chrf(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chrf) of pairs(keys, hyp, ref)."""
    return pairs.select(*keys, text_scores("hyp", "ref")["chrf"].alias("chrf"))


def trigram_cosine(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, similarity): the default text embedding, counts of character trigrams, compared by
    cosine. A stand-in for a sentence encoder, exact and reproducible; equal texts give 1."""
    return pairs.select(*keys, text_scores("hyp", "ref")["similarity"].alias("similarity"))


def improvement(length: Column, longest: Column, mean_chrf: Column) -> Column:
    """How much a text adds to what models gave: by length and by character F-score."""
    by_length = F.when(length > 1.3 * longest, 0.7).when(length > longest, 0.5).otherwise(0.2)
    return by_length * 0.3 + F.least(2 * mean_chrf, F.lit(1.0)) * 0.7


def judge_reply(decoded: Column) -> Column:
    """1 if the reply has a 1 and its last ten characters no 0, else 0."""
    return F.when(F.contains(decoded, F.lit("1")) & ~F.contains(F.right(decoded, F.lit(10)), F.lit("0")), F.lit(1.0)).otherwise(F.lit(0.0))


def final_score(max_chrf: Column, max_ratio: Column, judge: Column, weights: tuple[float, float, float] = (0.4, 0.1, 0.5)) -> Column:
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    return weights[0] * max_chrf + weights[1] * max_ratio + weights[2] * judge
