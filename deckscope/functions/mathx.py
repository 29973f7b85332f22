"""Math column expressions missing from both Spark and DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 7.1.26 rational approximation of erf (|error| <= 1.5e-7).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * ax)
    poly = F.lit(ERF_A[4])
    for a in reversed(ERF_A[:4]):
        poly = poly * t + F.lit(a)
    y = F.lit(1.0) - poly * t * F.exp(-(ax * ax))
    return F.when(x < 0, -y).otherwise(y)


def normal_cdf(x: Column, mean: Column, sd: Column) -> Column:
    """Normal CDF via :func:`erf`: 0.5 * (1 + erf((x - mean) / (sd * sqrt 2)))."""
    return F.lit(0.5) * (F.lit(1.0) + erf((x - mean) / (sd * F.lit(math.sqrt(2.0)))))
