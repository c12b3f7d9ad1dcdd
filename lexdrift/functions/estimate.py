"""Scalars of the estimate: smoothed frequency, gap, ratio, usage, and their errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALMOST_ONE = 0.9999999999999999
#: Below this a difference of two frequencies is what rounding leaves of 0.
ROUNDING = 1e-9


def smoothed(n: Column, total: Column) -> Column:
    """(n + 1) / (total + 1); 1 for a period without papers."""
    return (n + 1) / (total + 1)


def ratio(q: Column, p: Column) -> Column:
    """q / p; null where p is 0 but for rounding."""
    return F.when(F.abs(p) >= ROUNDING, q / p)


def gap(q: Column, p: Column) -> Column:
    return q - p


def usage(q: Column, p: Column) -> Column:
    """Lower bound of the share of papers written with help: (q - p) / (1 - p); null where p is 1 but for rounding."""
    return F.when(F.abs(1 - p) >= ROUNDING, (q - p) / (1 - p))


def band(x: Column, error: Column) -> tuple[Column, Column]:
    """The interval of an estimate: one error below and above."""
    return x - error, x + error


def binomial_variance(p: Column, n: Column) -> Column:
    return F.try_divide(p * (1 - p), n)


def standard_error(p: Column, q: Column, n: Column, version: str, regression: Column | None = None, function: str = "usage") -> Column:
    """Error of the usage or the gap, of the binomial variance of q and the variance of p: `binomial`, `regression` or `both` added.

    p from 1 up and q = 1 count as just below 1. Null where p has no valid variance.
    """
    if version not in ("binomial", "regression", "both") or function not in ("usage", "gap"):
        raise ValueError("version is binomial, regression or both; function usage or gap")
    p = F.when(p >= 1, ALMOST_ONE).otherwise(p)
    q = F.when(q == 1, ALMOST_ONE).otherwise(q)
    var = binomial_variance(p, n) if version == "binomial" else regression * regression
    if version == "both":
        var = var + binomial_variance(p, n)
    own = binomial_variance(q, n)
    if function == "gap":
        total = var + own
    else:
        total = ((q - 1) / F.pow(1 - p, 2)) * ((q - 1) / F.pow(1 - p, 2)) * var + own / F.pow(1 - p, 2)
    return F.when(total >= 0, F.sqrt(total))


def is_excess(ratio_: Column, gap_: Column, frequency: Column, factor: float = 2.0, least_gap: float = 0.01, least: float = 1e-3) -> Column:
    """Whether a word is in excess: its ratio above a line in log-log space, or its gap large; rare words never are."""
    line = F.log10(F.lit(factor)) - (F.log10(frequency) + 4) * F.log10(F.lit(factor)) / 4
    return ((F.log10(ratio_) > line) | (gap_ > least_gap)) & (frequency >= least)


def label_rule(ratio_: Column, gap_: Column, frequency: Column, factor: float = 2.2, least_gap: float = 0.011, most_ratio: float = 90, most_gap: float = 0.049) -> dict[str, Column]:
    """What a plot of excess words shows of a word: its ratio and gap, clipped, and whether it is labelled by the one (above a line in log-log space) and by the other."""
    clipped, below = F.least(ratio_, F.lit(most_ratio)), F.least(gap_, F.lit(most_gap))
    line = F.log10(F.lit(factor)) - (F.log10(frequency) + 4) * F.log10(F.lit(2.0)) / 4
    return {"ratio": clipped, "gap": below, "by_ratio": F.coalesce(F.log10(clipped) > line, F.lit(False)), "by_gap": F.coalesce(below > least_gap, F.lit(False))}
