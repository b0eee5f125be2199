"""Small column expressions used all over the package."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediacast.contracts import MISSING_TEXT

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(?i)[+-]?inf(inity)?$"
_TIME = r"(?:[T ]([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?Z?)?$"
_YEAR_FIRST = r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})" + _TIME
_MONTH_FIRST = r"^(\d{1,2})/(\d{1,2})/(\d{4})" + _TIME
_NAMED_MONTH = ["MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy"]


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def present_text(c: Column) -> Column:
    """Null for any cell text that stands for a missing value."""
    return F.when(~c.isin(MISSING_TEXT), c)


def number(c: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def day(c: Column) -> Column:
    """Text to date; anything that is not a date becomes null.

    Year-month-day with dashes or slashes and month/day/year, both with or without a time, and English month names.
    Patterns are only matched where the text is not a plain date already.
    """
    text = strip(c.cast("string"))
    year_first = F.regexp_replace(text, _YEAR_FIRST, "$1-$3-$4").try_cast("date")
    month_first = F.regexp_replace(text, _MONTH_FIRST, "$3-$1-$2").try_cast("date")
    named = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in _NAMED_MONTH])
    return (
        F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), text.try_cast("date"))
        .when(text.rlike(_YEAR_FIRST), year_first)
        .when(text.rlike(_MONTH_FIRST), month_first)
        .when(text.rlike("[A-Za-z]"), named)
    )


def campaign_key() -> Column:
    return F.concat_ws(":", "source_system", "source_campaign_id")


def clip(c: Column, low: float, high: float) -> Column:
    """Bounded value; null stays null, although greatest and least alone would skip it."""
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator)


def joined_flags(*flags: Column) -> Column:
    """Non-null flags in the given order, separated by semicolons."""
    return F.array_join(F.array_compact(F.array(*flags)), ";")


def wilson_bound(successes: Column, observations: Column, side: int, z: float = 1.96) -> Column:
    """Lower (side -1) or upper (side +1) end of a Wilson interval, null without observations."""
    n = observations.cast("double")
    p = successes / n
    denominator = 1.0 + z**2 / n
    centre = (p + z**2 / (2.0 * n)) / denominator
    margin = z * F.sqrt(p * (1.0 - p) / n + z**2 / (4.0 * n * n)) / denominator
    end = F.greatest(F.lit(0.0), centre - margin) if side < 0 else F.least(F.lit(1.0), centre + margin)
    return F.when(observations > 0, F.round(end, 4))


def curve_scale(budget: Column) -> tuple[Column, Column]:
    """Saturation scale and normalisation of the logarithmic response anchored at ``budget``."""
    anchor = F.greatest(budget, F.lit(1.0))
    scale = F.greatest(anchor * 1.5, F.lit(1.0))
    return scale, anchor / (scale * F.log1p(anchor / scale))


def response_revenue(budget: Column, roas: Column, allocated: Column) -> Column:
    """Concave revenue response that meets ``budget * roas`` at the baseline budget."""
    scale, norm = curve_scale(budget)
    return F.greatest(F.lit(0.0), roas * scale * F.log1p(F.greatest(allocated, F.lit(0.0)) / scale) * norm)


def marginal_revenue(budget: Column, roas: Column, allocated: Column) -> Column:
    """Slope of :func:`response_revenue` at the allocated amount."""
    scale, norm = curve_scale(budget)
    return F.greatest(F.lit(0.0), roas * norm / (1.0 + F.greatest(allocated, F.lit(0.0)) / scale))
