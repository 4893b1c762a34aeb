"""Ranking and similarity formulas as Column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("own", "robertson", "lucene", "atire", "bm25l", "bm25+")
#: Methods under which a document scores even for terms that it lacks.
SHIFTED = ("bm25l", "bm25+")
CENTRE = (48.521636, 9.057645)
EARTH_KM = 6371.0088


def idf(method: str, n: Column, df: Column) -> Column:
    """Inverse document frequency of each BM25 variant."""
    rest = (n - df + 0.5) / (df + 0.5)
    return {
        "own": lambda: F.log(1 + rest),
        "lucene": lambda: F.log(1 + rest),
        "robertson": lambda: F.log(F.greatest(F.lit(1.0), rest)),
        "atire": lambda: F.log(n / df),
        "bm25l": lambda: F.log((n + 1) / (df + 0.5)),
        "bm25+": lambda: F.log((n + 1) / df),
    }[method]()


def saturation(method: str, tf: Column, dl: Column, avgdl: Column, k1: float, b: float, delta: float) -> Column:
    """Term-frequency part of each BM25 variant."""
    norm = 1 - b + b * dl / avgdl
    plain = tf / (tf + k1 * norm)
    return {
        "own": lambda: plain,
        "robertson": lambda: plain,
        "lucene": lambda: plain,
        "atire": lambda: tf * (k1 + 1) / (tf + k1 * norm),
        "bm25l": lambda: (k1 + 1) * (tf / norm + delta) / (k1 + tf / norm + delta),
        "bm25+": lambda: (k1 + 1) * tf / (k1 * norm + tf) + delta,
    }[method]()


def absent(method: str, k1: float, delta: float) -> float:
    """The term-frequency part of a term that a document lacks."""
    return {"bm25l": (k1 + 1) * delta / (k1 + delta), "bm25+": delta}.get(method, 0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors; 0 if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, size(a) * size(b)), F.lit(0.0))


#: Buckets of the stand-in embedding, one for each hexadecimal digit.
EMBEDDING = 16


def hashed_embedding(tokens: Column) -> Column:
    """A stand-in for a sentence embedding that needs no model: counts of tokens by the first digit of their md5."""
    digits = F.array_join(F.transform(tokens, lambda t: F.substring(F.md5(t), 1, 1)), "")
    # Counted in a string of digits, not element by element.
    counts = lambda held: F.array(*[(F.length(held) - F.length(F.replace(held, F.lit(f"{i:x}")))).cast("double") for i in range(EMBEDDING)])
    # As the one element of an array, the digits are made once and not for each bucket.
    return F.element_at(F.transform(F.array(digits), counts), 1)


def haversine(lat: Column, lon: Column, centre: tuple[float, float] = CENTRE) -> Column:
    """Kilometres to a centre on a sphere."""
    a, o = F.radians(lat), F.radians(lon)
    a0, o0 = math.radians(centre[0]), math.radians(centre[1])
    h = F.pow(F.sin((a - a0) / 2), 2) + F.cos(a) * math.cos(a0) * F.pow(F.sin((o - o0) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def geodesic_km(lat: float, lon: float, centre: tuple[float, float] = CENTRE) -> float:
    """Kilometres on the WGS-84 ellipsoid by Vincenty's inverse formula."""
    a, f = 6378.137, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (centre[0], lat))
    length = math.radians(lon - centre[1])
    lam = length
    for _ in range(200):
        s, c = math.sin(lam), math.cos(lam)
        sin_sigma = math.hypot(math.cos(u2) * s, math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * c)
        if sin_sigma == 0:
            return 0.0
        cos_sigma = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * c
        sigma = math.atan2(sin_sigma, cos_sigma)
        sin_alpha = math.cos(u1) * math.cos(u2) * s / sin_sigma
        cos2 = 1 - sin_alpha**2
        mid = cos_sigma - 2 * math.sin(u1) * math.sin(u2) / cos2 if cos2 else 0.0
        k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
        before, lam = lam, length + (1 - k) * f * sin_alpha * (sigma + k * sin_sigma * (mid + k * cos_sigma * (2 * mid**2 - 1)))
        if abs(lam - before) < 1e-12:
            break
    u = cos2 * (a**2 - b**2) / b**2
    big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    turn = big_b * sin_sigma * (mid + big_b / 4 * (cos_sigma * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * sin_sigma**2 - 3) * (4 * mid**2 - 3)))
    return b * big_a * (sigma - turn)


def min_max(x: Column, low: Column, high: Column) -> Column:
    """x between its least and greatest; 0 where they are equal."""
    return F.coalesce(F.try_divide((x - low).cast("double"), (high - low).cast("double")), F.lit(0.0))


#: Class weights of relevance grades: the inverse of their shares, against the share of grade 0.
GRADE_WEIGHTS = {0: 1.0, 1: 59.4 / 28.3, 2: 59.4 / 7.1, 3: 59.4 / 5.2}


def graded_label(grade: Column, score: Column, low: Column, high: Column) -> Column:
    """Grade weight plus score, scaled between its extremes, in classes 1 to 5."""
    return (F.ceil(min_max(grade_weight(grade) + score, low, high) * 4) + 1).cast("int")


def grade_weight(grade: Column) -> Column:
    out = F.lit(None).cast("double")
    for g, w in GRADE_WEIGHTS.items():
        out = F.when(grade == g, w).otherwise(out)
    return out
