"""Special functions Spark lacks, and portable hashing, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_GOALS_SUPPORT = 256
HASH_SPAN = 1 << 32


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_factorials(n: int = MAX_GOALS_SUPPORT) -> Column:
    """Constant array with ln(k!) at position k (0-based)."""
    return F.array(*[F.lit(math.lgamma(k + 1.0)) for k in range(n + 1)])


def log_factorial(k) -> Column:
    return F.element_at(log_factorials(), _col(k).cast("int") + 1)


def poisson_logpmf(k, rate) -> Column:
    k, rate = _col(k), _col(rate)
    return k * F.ln(rate) - rate - log_factorial(k)


# Abramowitz & Stegun 26.2.17 (fixed values)
NORMAL_CDF_P = 0.2316419
NORMAL_CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(z) -> Column:
    z = _col(z)
    t = 1.0 / (1.0 + NORMAL_CDF_P * F.abs(z))
    poly = F.lit(0.0)
    for b in reversed(NORMAL_CDF_B):
        poly = (poly + b) * t
    upper = F.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi) * poly
    return F.when(z >= 0, 1.0 - upper).otherwise(upper)


def hash32(*parts) -> Column:
    """First 32 bits of md5 over the '|'-joined parts: the same in any engine."""
    text = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def binomial_tail(k, n, p: float = 0.5) -> Column:
    """P(X >= k) for X ~ Binomial(n, p), by a running ratio of terms.

    Starts from the largest term in range so that nothing underflows: the first
    term is found in log space with Stirling's series.
    """
    k, n = _col(k).cast("double"), _col(n).cast("double")
    logit = math.log(p) - math.log1p(-p)

    def lgamma1(x):
        x = x + 1.0
        big = x + 8.0
        series = ((big - 0.5) * F.ln(big) - big + 0.5 * math.log(2 * math.pi) + 1.0 / (12.0 * big)
                  - 1.0 / (360.0 * big * big * big) + 1.0 / (1260.0 * big * big * big * big * big))
        product = x
        for i in range(1, 8):
            product = product * (x + float(i))
        return series - F.ln(product)

    def term(i):
        return F.exp(lgamma1(n) - lgamma1(i) - lgamma1(n - i) + i * logit + n * math.log1p(-p))

    # terms more than 60 standard deviations above the mean are below 1e-300
    spread = F.ceil(60.0 * F.sqrt(n * p * (1 - p)) + 60.0)
    top = F.least(n, F.greatest(k, n * p) + spread)
    low = F.greatest(k, F.floor(n * p) - spread)
    total = F.aggregate(F.sequence(low.cast("bigint"), top.cast("bigint")), F.lit(0.0),
                        lambda acc, i: acc + term(i.cast("double")))
    return F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0)).otherwise(F.least(F.lit(1.0), total))
