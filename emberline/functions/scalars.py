"""Scalar expressions: logistic, decibels, tiers, packed tokens, vectors, hash sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tiers' lower bounds.
MAYBE, ALERT = 0.6, 0.8


def r6(c: Column | str) -> Column:
    """Six decimals, never a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def logistic(x: Column, limit: float = 30.0) -> Column:
    """Logistic with its argument held within ``limit``."""
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-limit), F.least(F.lit(limit), x))))


def power_db(x: Column, floor: float = 1e-9) -> Column:
    return 10.0 * F.log10(F.greatest(x, F.lit(floor)))


def db_power(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 10.0)


def amplitude_db(x: Column, floor: float = 1e-9) -> Column:
    return 20.0 * F.log10(F.greatest(F.abs(x), F.lit(floor)))


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1.0 - 1e-12), p))
    return F.ln(p / (1.0 - p))


def shifted_score(score: Column, threshold: Column, at: float = ALERT) -> Column:
    """A score moved on the logit scale so that ``threshold`` shows as ``at``."""
    z = logit(score) + logit(F.lit(at)) - logit(threshold)
    return 1.0 / (1.0 + F.exp(-z))


def log_loss(z: Column, target: Column) -> Column:
    """Cross entropy of a margin, stable for large ones."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - target * z


def risk_tier(score: Column) -> Column:
    """``unknown`` unless the score is a number in [0, 1]; then by inclusive bounds."""
    valid = score.isNotNull() & ~F.isnan(score) & (score >= 0) & (score <= 1)
    return F.when(~F.coalesce(valid, F.lit(False)), "unknown").when(score >= ALERT, "alert").when(score >= MAYBE, "maybe").otherwise("low")


def tier_rank(score: Column) -> Column:
    return F.when(score >= ALERT, 2).when(score >= MAYBE, 1).otherwise(0)


def pack_token(low: Column, high: Column, gap: Column) -> Column:
    """Two frequency bins in thirds and half the frame gap, nine bits each."""
    third = lambda c: F.floor(c / 3).cast("long")
    return F.shiftleft(third(low), 18).bitwiseOR(F.shiftleft(third(high), 9)).bitwiseOR(F.floor(gap / 2).cast("long"))


def unpack_token(token: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(token, 18), F.shiftright(token, 9).bitwiseAND(F.lit(511)), token.bitwiseAND(F.lit(511))


def hash_number(*parts: Column | str, digits: int = 8) -> Column:
    """A whole number from the text of ``parts``, the same in any engine."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def hash_uniform(*parts: Column | str) -> Column:
    """A uniform in [0, 1) from the text of ``parts``, independent of partitioning."""
    return hash_number(*parts).cast("double") / float(1 << 32)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """0 where both are near zero; the cosine held within [-1, 1]."""
    na, nb = norm(a), norm(b)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.greatest(na * nb, F.lit(1e-12))))
    return F.when((na < 1e-12) & (nb < 1e-12), F.lit(0.0)).otherwise(1.0 - cosine)


def shares(values: Column) -> Column:
    """Squares of a vector's entries over their sum."""
    whole = F.greatest(dot(values, values), F.lit(1e-12))
    return F.transform(values, lambda x: x.cast("double") * x.cast("double") / whole)


def hellinger(p: Column, q: Column) -> Column:
    """Distance of two distributions."""
    return F.sqrt(total(F.zip_with(p, q, lambda x, y: F.pow(F.sqrt(x) - F.sqrt(y), F.lit(2.0)))) / 2.0)


def flatness(p: Column, floor: float = 1e-12) -> Column:
    """Geometric over arithmetic mean."""
    n = F.size(p)
    return F.exp(total(F.transform(p, lambda x: F.ln(F.greatest(x, F.lit(floor))))) / n) / F.greatest(total(p) / n, F.lit(floor))


def centroid(p: Column) -> Column:
    return total(F.transform(p, lambda x, i: x * i.cast("double"))) / F.greatest(total(p), F.lit(1e-12))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
