"""Score arithmetic: exact means, rounding and classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round4(x: Column) -> Column:
    """Four decimals, half away from zero, on doubles (the same in every engine)."""
    return F.signum(x) * F.floor(F.abs(x) * 10000.0 + 0.5) / 10000.0


def round_to(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def exact(x: Column) -> Column:
    """Scores as decimals, so that sums do not depend on the order of rows."""
    return x.cast("decimal(6,4)")


def mean(x: Column) -> Column:
    """Mean of the non-null scores; null without any."""
    return F.try_divide(F.sum(exact(x)).cast("double"), F.count(x))


def top_box(x: Column) -> Column:
    """1 counts fully, other positive scores as they are, the rest (null too) as 0."""
    return F.when(x == 1, 1.0).when(x > 0, x).otherwise(0.0)


def top_box_clamped(x: Column) -> Column:
    return F.when(x >= 1, 1.0).when(x > 0, x).otherwise(0.0)


# fixed values: Abramowitz and Stegun, formula 7.1.26
ERF_RATE, ERF_TERMS = 0.3275911, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)


def erf_complement(x, exp):
    """1 - erf(x) for x >= 0, of a column or a number; ``exp`` is its exponential function."""
    t = 1.0 / (1.0 + ERF_RATE * x)
    poly = 0.0
    for term in ERF_TERMS:
        poly = (poly + term) * t
    return poly * exp(-x * x)


def erf_complement_sql(t: str) -> str:
    """The same polynomial in SQL; ``t`` is 1 / (1 + ERF_RATE * x)."""
    poly = "0.0"
    for term in ERF_TERMS:
        poly = f"({poly} + {term}) * {t}"
    return f"({poly})"


def normal_p_value(stat: Column) -> Column:
    """Two-sided p-value by a polynomial error function, at least 0.0001."""
    return F.greatest(F.lit(0.0001), F.least(F.lit(1.0), erf_complement(F.abs(stat) / F.sqrt(F.lit(2.0)), F.exp)))


def sigmoid(z: Column) -> Column:
    p = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), z))))
    return F.greatest(F.lit(1e-5), F.least(F.lit(1.0 - 1e-5), p))


def clamp(x: Column, low: float, high: float) -> tuple[Column, Column]:
    """Bounded value, and whether bounding moved it by more than 0.00001."""
    bounded = F.greatest(F.lit(low), F.least(F.lit(high), x))
    return bounded, F.abs(x - bounded) > 0.00001


def percentage_to_share(x: Column) -> Column:
    """Values beyond 1 in magnitude are percentages."""
    return F.when(F.abs(x) > 1, round4(x / 100.0)).otherwise(x)


def sentiment(nps: Column) -> Column:
    """Promoter, passive or detractor; scores above 1 are on the scale of 0 to 10, others on -1 to 1.

    Null for a null score.
    """
    ten = nps > 1
    promoter, detractor = F.when(ten, nps >= 9).otherwise(nps > 0), F.when(ten, nps <= 6).otherwise(nps < 0)
    return F.when(nps.isNull(), F.lit(None)).when(promoter, "promoter").when(detractor, "detractor").otherwise("passive")


def goal_status(value: Column, target: Column, warning: Column) -> Column:
    return F.when(value.isNull(), "no_sample").when(value >= target, "on_target").when(warning.isNotNull() & (value >= warning), "warning").otherwise("critical")


def tier(value: Column, green: float = 0.65, red: float = 0.55) -> Column:
    return F.when(value >= green, "green").when(value >= red, "yellow").otherwise("red")


def excel_date(serial: Column) -> Column:
    """Date of a spreadsheet serial number."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))


def percent_text(x: Column) -> Column:
    """A share as a percentage with one decimal."""
    return F.concat(F.format_string("%.1f", round_to(x * 100.0, 1)), F.lit("%"))
