"""Normal distribution as plain arithmetic Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published rational approximations (Hart/West for the CDF, Acklam for its inverse).
P = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
Q = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
A = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
B = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
C = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
D = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]


def _poly(c: list[float], x: Column) -> Column:
    out = F.lit(c[0])
    for k in c[1:]:
        out = out * x + F.lit(k)
    return out


def bound(x: Column, f) -> Column:
    """f(x) with x evaluated once: a lambda's variable keeps the expression from being copied at each use."""
    return F.element_at(F.transform(F.array(x.cast("double")), f), 1)


def normal_cdf(x: Column) -> Column:
    def of(v: Column) -> Column:
        z = F.abs(v)
        e = F.exp(-z * z / 2)
        tail = z + F.lit(1.0) / (z + F.lit(2.0) / (z + F.lit(3.0) / (z + F.lit(4.0) / (z + F.lit(0.65)))))
        c = F.when(z > 37, 0.0).when(z < 7.07106781186547, e * _poly(P, z) / _poly(Q, z)).otherwise(e / tail / F.lit(2.506628274631))
        return bound(c, lambda y: F.when(v > 0, 1 - y).otherwise(y))

    return bound(x, of)


def normal_inverse(p: Column) -> Column:
    """Quantile of p in (0, 1); null outside."""

    def start(v: Column) -> Column:
        q = v - 0.5
        low = F.sqrt(-2 * F.log(F.least(v, 1 - v)))
        edge = bound(low, lambda y: _poly(C, y) / _poly(D, y))
        return F.when((v >= 0.02425) & (v <= 1 - 0.02425), q * _poly(A, q * q) / _poly(B, q * q)).when(v < 0.02425, edge).otherwise(-edge)

    def refined(v: Column) -> Column:
        def step(x: Column) -> Column:
            u = (normal_cdf(x) - v) * F.lit(2.5066282746310002) * F.exp(x * x / 2)
            return bound(u, lambda y: x - y / (1 + x * y / 2))

        return F.when((v > 0) & (v < 1), bound(start(v), step))

    return bound(p, refined)


def normal_log_cdf(x: Column) -> Column:
    """Logarithm of the distribution function; finite where the function itself is too small for a double."""

    def below(z: Column) -> Column:
        tail = z + F.lit(1.0) / (z + F.lit(2.0) / (z + F.lit(3.0) / (z + F.lit(4.0) / (z + F.lit(0.65)))))
        return -z * z / 2 + F.when(z < 7.07106781186547, F.log(_poly(P, z) / _poly(Q, z))).otherwise(-F.log(tail) - F.log(F.lit(2.506628274631)))

    return bound(x, lambda v: bound(below(F.abs(v)), lambda y: F.when(v > 0, F.log1p(-F.exp(y))).otherwise(y)))


def normal_inverse_log(p: Column) -> Column:
    """Quantile of the probability whose logarithm is ``p``, below 0; null outside. Exact far into the lower tail, where a probability underflows."""

    def start(y: Column) -> Column:
        q = F.exp(y) - 0.5
        edge = bound(F.sqrt(-2 * y), lambda s: _poly(C, s) / _poly(D, s))
        return F.when(q >= 0.02425 - 0.5, q * _poly(A, q * q) / _poly(B, q * q)).otherwise(edge)

    def lower(y: Column) -> Column:
        def step(x: Column) -> Column:
            # Newton's step on the logarithm: its slope is the density over the distribution function
            return bound(x, lambda v: bound(normal_log_cdf(v), lambda c: v - (c - y) * F.lit(2.5066282746310002) * F.exp(v * v / 2 + c)))

        return step(step(step(start(y))))

    half = math.log(0.5)
    return bound(p, lambda v: F.when(v <= half, bound(F.when((v > float("-inf")) & (v <= half), v), lower)).when(v < 0, -bound(F.log(-F.expm1(v)), lower)))


def normal_round_trip(x: Column) -> Column:
    """x back from the probability of its own tail: the other tail's distance from 1 is lost in a double from x = 8 on."""
    return bound(x, lambda v: bound(normal_inverse_log(normal_log_cdf(-F.abs(v))), lambda y: F.when(v > 0, -y).otherwise(y)))
