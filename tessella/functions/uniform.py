"""Deterministic uniforms and the inverse normal.

A draw is a hash of (seed, row key), so a lost task redraws the same values
and any repartitioning gives the same rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

# Acklam's rational approximation of the inverse normal.
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)
_LOW = 0.02425


def member_seed(seed: int, index: int) -> int:
    """The seed of one ensemble member: a hash of the pair, so neighbours never share one."""
    digest = hashlib.sha256(f"{seed}/{index}".encode()).hexdigest()
    return int(digest[:8], 16) % 2**31


def hash_uniform(seed, *keys: Column) -> Column:
    """A uniform in [0, 1) from 32 bits of ``md5(seed-key-...)``."""
    parts = [F.lit(str(seed))] + [k.cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_ppf(p: Column) -> Column:
    """The inverse normal CDF, relative error below 1.2e-9."""
    def tail(q: Column) -> Column:
        r = F.sqrt(F.lit(-2.0) * F.ln(q))
        return _horner(_C, r) / (_horner(_D, r) * r + F.lit(1.0))
    q = p - F.lit(0.5)
    r = q * q
    center = _horner(_A, r) * q / (_horner(_B, r) * r + F.lit(1.0))
    return F.when(p < _LOW, tail(p)).when(p > 1 - _LOW, -tail(F.lit(1.0) - p)).otherwise(center)


def noise(seed, *keys: Column) -> Column:
    """A standard normal draw for a row key."""
    return normal_ppf(F.greatest(hash_uniform(seed, *keys), F.lit(2.0**-33)))
