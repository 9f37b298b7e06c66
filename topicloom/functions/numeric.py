"""Numeric column functions: rounding, vectors as arrays, soft maxima and the closed forms of directional statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def r6(x) -> Column:
    """x at six decimals, the same in every engine: half up, with a hair's breadth of slack for sums in another order."""
    return F.floor(_c(x) * F.lit(1e6) + F.lit(0.5001)) / F.lit(1e6)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v) -> Column:
    return _c(v).cast("array<double>")


def total(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def unit(v, eps: float = EPS) -> Column:
    """v over its length plus eps."""
    n = norm(v) + F.lit(eps)
    return F.transform(_c(v), lambda x: x / n)


def unit_safe(v) -> Column:
    """v over its length; v itself where that is zero or no number."""
    n = F.when((norm(v) > 0) & ~F.isnan(norm(v)), norm(v)).otherwise(F.lit(1.0))
    return F.transform(_c(v), lambda x: x / n)


def cosine(a, b) -> Column:
    """0 if either vector has no length."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(both == 0, F.lit(1.0)).otherwise(both))


def logsumexp(v, eps: float = 0.0) -> Column:
    """Logarithm of the sum of exponentials, with eps added inside the logarithm if asked."""
    top = F.array_max(_c(v))
    return top + F.ln(total(F.transform(_c(v), lambda x: F.exp(x - top))) + F.lit(eps))


def softmax(v, temperature: float = 1.0) -> Column:
    """Tempered soft maximum; uniform where the weights vanish."""
    scaled = F.transform(_c(v), lambda x: x / F.lit(temperature))
    top = F.array_max(scaled)
    raised = F.transform(scaled, lambda x: F.exp(x - top))
    mass = total(raised)
    uniform = F.transform(_c(v), lambda x: F.lit(1.0) / F.size(_c(v)))
    return F.when(mass > 0, F.transform(raised, lambda x: x / mass)).otherwise(uniform)


def argmax(v) -> Column:
    """Index from 0 of the largest element, the first of several."""
    return (F.array_position(_c(v), F.array_max(_c(v))) - 1).cast("int")


def unit_interval(v) -> Column:
    low, high = F.array_min(_c(v)), F.array_max(_c(v))
    return F.transform(_c(v), lambda x: F.least(F.greatest((x - low) / (high - low + F.lit(EPS)), F.lit(0.0)), F.lit(1.0)))


def kappa(resultant, n, dim: int, default: float = 10.0, clip: float = 1e-6, low: float = 0.0, high: float = 1e30) -> Column:
    """Concentration r (D - r^2) / (1 - r^2) of n unit vectors whose sum has length resultant; default for one vector or none."""
    r = F.least(F.greatest(_c(resultant) / _c(n), F.lit(clip)), F.lit(1.0 - clip))
    raw = r * (F.lit(float(dim)) - r * r) / (F.lit(1.0) - r * r)
    return F.when(_c(n) <= 1, F.lit(default)).otherwise(F.least(F.greatest(raw, F.lit(low)), F.lit(high)))


def safe_exp(x) -> Column:
    """exp(x), infinite beyond the range of doubles."""
    return F.when(_c(x) > 709.0, F.lit(float("inf"))).otherwise(F.exp(F.least(_c(x), F.lit(709.0))))


def sigfigs(x, digits: int = 4) -> Column:
    return F.when(F.isnan(_c(x)), _c(x)).otherwise(F.format_string(f"%.{digits}g", _c(x)).cast("double"))


# Driver-side forms, for parameters of a few topics.


def log_bessel_i(order: float, x: float) -> float:
    """Logarithm of the modified Bessel function of the first kind."""
    if x <= 0:
        return -math.inf if order > 0 else 0.0
    if x > 50 and x > 2 * order or order > 50:
        # uniform expansion for large order or argument
        v = max(order, 1e-8)
        z = x / v
        s = math.sqrt(1 + z * z)
        t = 1 / s
        eta = s + math.log(z / (1 + s))
        u1 = (3 * t - 5 * t**3) / 24
        u2 = (81 * t**2 - 462 * t**4 + 385 * t**6) / 1152
        return v * eta - 0.5 * math.log(2 * math.pi * v) - 0.5 * math.log(s) + math.log(1 + u1 / v + u2 / v**2)
    terms, m = [], 0
    while True:
        terms.append((2 * m + order) * math.log(x / 2) - math.lgamma(m + 1) - math.lgamma(m + order + 1))
        if m > x and terms[-1] < max(terms) - 40:
            break
        m += 1
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def vmf_log_normaliser(kappa_: float, dim: int) -> float:
    """v ln k - (D/2) ln 2 pi - ln I_v(k), v = D/2 - 1; the scaled Bessel value is kept at 1e-300 or above."""
    k = max(kappa_, 1e-12)
    v = dim / 2 - 1
    scaled = max(log_bessel_i(v, k) - k, math.log(1e-300))
    return v * math.log(k) - dim / 2 * math.log(2 * math.pi) - (scaled + k)


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))
