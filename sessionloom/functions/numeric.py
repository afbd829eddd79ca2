"""Column expressions for scores, clips and guarded ratios (SCA-01..06, SCA-25)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_TO_SIGMA = 1.4826
NORMAL_Q75 = 0.67448975


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x: str | Column, digits: int = 6) -> Column:
    """Round for output; adding zero turns -0.0 into 0.0."""
    return F.round(col(x).cast("double"), digits) + F.lit(0.0)


def quantise(x: str | Column, digits: int = 4) -> Column:
    """Half-even rounding with a positive zero (SCA-03)."""
    return F.bround(col(x).cast("double"), digits) + F.lit(0.0)


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, null when the denominator is null or zero."""
    den = col(den)
    return F.when(den != 0, col(num) / den)


def clip100(x: str | Column) -> Column:
    return F.when(col(x).isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), col(x))))


def linear_score(x: str | Column, low: float, high: float) -> Column:
    return clip100(F.lit(100.0) * (col(x) - F.lit(low)) / F.lit(high - low))


def declining_score(x: str | Column, low: float, high: float) -> Column:
    return F.lit(100.0) - linear_score(x, low, high)


def triangular_score(x: str | Column, low: float, center: float, high: float) -> Column:
    x = col(x)
    return (
        F.when(x.isNull(), F.lit(None).cast("double"))
        .when((x <= low) | (x >= high), 0.0)
        .when(x <= center, clip100(F.lit(100.0) * (x - low) / F.lit(center - low)))
        .otherwise(clip100(F.lit(100.0) * (F.lit(high) - x) / F.lit(high - center)))
    )


def log_linear_score(x: str | Column, low: float, high: float) -> Column:
    """Linear score on log10; non-positive input has no score."""
    x = col(x)
    lo, hi = F.log10(F.lit(low)), F.log10(F.lit(high))
    return F.when(x > 0, clip100(F.lit(100.0) * (F.log10(x) - lo) / (hi - lo)))


def normalised(x: str | Column, method: str, low: float, high: float, center: float | None = None) -> Column:
    if method == "triangular":
        return triangular_score(x, low, center, high)
    return declining_score(x, low, high) if method == "declining" else linear_score(x, low, high)


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Sorted array of the codes whose condition holds (all are evaluated)."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in pairs])))


def first_failing(*pairs: tuple[Column, str | Column], ok: str) -> Column:
    """Ordered ladder: the first condition that holds names the outcome."""
    out = None
    for cond, code in pairs:
        code = F.lit(code) if isinstance(code, str) else code
        out = F.when(cond, code) if out is None else out.when(cond, code)
    return out.otherwise(ok)


def joined(codes: Column) -> Column:
    return F.array_join(codes, "|")


def sorted_middle(values: Column) -> Column:
    """Exact median of a short array (a bounded window frame)."""
    s = F.sort_array(F.array_compact(values))  # array_sort would call a comparator for each pair; nulls count and come last
    n = F.size(values)
    hi = F.get(s, F.floor(n / 2).cast("int"))
    lo = F.get(s, (F.greatest(F.floor((n + 1) / 2), F.lit(1)) - 1).cast("int"))
    return F.when(n > 0, (lo + hi) / 2.0)


def redistribute(weights: Sequence[tuple[Column, float]]) -> list[Column]:
    """Spread 100 over the available parts, the last available one takes the remainder (SCA-04)."""
    total = sum((F.when(a, F.lit(float(w))).otherwise(0.0) for a, w in weights), F.lit(0.0))
    n = len(weights)
    shares = [F.when(a, F.bround(F.lit(float(w)) * 100.0 / total, 4)).otherwise(0.0) for a, w in weights]
    out = []
    for i, (avail, _) in enumerate(weights):
        later = F.lit(False)
        for j in range(i + 1, n):
            later = later | weights[j][0]
        before = sum(shares[:i], F.lit(0.0))
        out.append(F.when(~avail, 0.0).when(later, shares[i]).otherwise(F.bround(100.0 - before, 4)))
    return out
