"""Small scalar expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

POWER_FLOOR = 1e-30


def uniform(seed, *keys) -> Column:
    """Counter-based uniform in [0, 1): the first 52 bits of md5(seed|key|...).

    It depends on the keys only, never on partition order, so a lost task that
    is run again draws the same numbers.
    """
    return hash_bits(seed, *keys, digits=13) / float(1 << 52)


def hash_bits(seed, *keys, digits: int = 13) -> Column:
    parts = [F.lit(str(seed))] + [_c(k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, digits), 16, 10).cast("bigint")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def spearman_brown(r) -> Column:
    """Full-length reliability from a half-length correlation; null at r <= -1."""
    r = _c(r)
    return F.when(r > -1, 2.0 * r / (1.0 + r))


def natural_log(x, log=F.log) -> Column:
    """Logarithm, natural by default, with minus infinity at zero and NaN below, where ``F.log`` gives null."""
    x = _c(x)
    return F.coalesce(log(x), F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))))


def decibel_ratio(a, b, floor: float = POWER_FLOOR) -> Column:
    """Ratio in decibel; NaN when it is negative, as the SQL says."""
    return 10.0 * natural_log((_c(a) + floor) / (_c(b) + floor), F.log10)


def logit(p, clip: float = 1e-6) -> Column:
    q = F.greatest(F.lit(clip), F.least(F.lit(1.0 - clip), _c(p)))
    return F.log(q / (1.0 - q))


def null_if_nan(x) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x), x)


def safe_ratio(a, b) -> Column:
    """a / b, null when b is zero or null."""
    b = _c(b)
    return F.when(b != 0, _c(a) / b)


def dot(a, b) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def normalise(v) -> Column:
    v = _c(v)
    # the length is bound by an outer lambda; inside the inner one it would be computed again for every element
    return F.transform(F.array(F.sqrt(dot(v, v))), lambda size: F.transform(v, lambda x: x.cast("double") / size))[0]


def angular_distance(a, b) -> Column:
    """Angle in radians between two unit vectors; the cosine is clipped to [-1, 1]."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def unit_phase(re, im, floor: float = POWER_FLOOR) -> tuple[Column, Column]:
    size = F.greatest(F.hypot(_c(re), _c(im)), F.lit(floor))
    return _c(re) / size, _c(im) / size


def samples_to_ms(samples, sfreq: float) -> Column:
    return _c(samples) * 1000.0 / sfreq


def ms_to_samples(ms, sfreq: float) -> Column:
    return F.round(_c(ms) * sfreq / 1000.0).cast("bigint")


def normalise_trigger(code) -> Column:
    """Low byte of a status word."""
    return _c(code).bitwiseAND(255)


def reasons(*rules: tuple[Column, str]) -> Column:
    """``;``-joined labels of the rules that hold; empty text when none does."""
    labels = [F.when(F.coalesce(cond, F.lit(False)), F.lit(label)) for cond, label in rules]
    return F.array_join(F.array_compact(F.array(*labels)), ";")


def one_of(column, table: dict, default: Column | None = None) -> Column:
    """Recode by a small fixed dictionary, written as one expression."""
    pairs = list(table.items())
    expr = F.when(_c(column) == F.lit(pairs[0][0]), F.lit(pairs[0][1]))
    for key, value in pairs[1:]:
        expr = expr.when(_c(column) == F.lit(key), F.lit(value))
    return expr if default is None else expr.otherwise(default)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)
