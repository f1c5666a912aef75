"""Numeric rules: shares, differences, levels and statuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Availability levels in percent with their ratings, and the
# week-average impact levels in percent.
AVAILABILITY_RATINGS = (
    (30, "-Bad"),
    (50, "-Poor"),
    (65, "Acceptable"),
    (80, "Good"),
    (95, "Excellent"),
    (100, "Exceptional"),
)
IMPACT_LEVELS = (-4.0, -2.0, 0.0, 1.5, 3.0, 4.5)
BOTH_MISSING, PREVIOUS_MISSING = "both-missing", "previous-missing"
SELECTED_MISSING, NONE_MISSING = "selected-missing", "none"


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def exact_mean(value: Column) -> Column:
    """Mean that does not depend on row order: exact sum first, one division last."""
    return F.try_divide(F.sum(value).cast("double"), F.count(value))


def per_day(total: Column, days: Column) -> Column:
    """Daily share of a total; NULL when there are no days."""
    return F.try_divide(total.cast("double"), days)


def percent_of(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole) * 100


def whole_number(value: Column) -> Column:
    """Cut the fraction off, towards zero."""
    return value.cast("bigint")


def direction(value: Column, base: Column) -> Column:
    """``normal`` when value holds up to base, ``inverse`` when below, else ``off``."""
    return (
        F.when(value >= base, "normal").when(base > value, "inverse").otherwise("off")
    )


def nearest(value: Column, levels: Sequence[tuple[float, object]]) -> Column:
    """Label of the level closest to ``value``; NULL stays NULL.

    ``levels`` rise, so the closest one is found by comparing with the midpoints.
    A value on a midpoint belongs to the lower level.
    """
    chosen = F.when(value.isNull(), F.lit(None))
    for (low, label), (high, _) in zip(levels, levels[1:]):
        chosen = chosen.when(value <= (low + high) / 2, F.lit(label))
    return chosen.otherwise(F.lit(levels[-1][1]))


def availability_rating(percent: Column) -> Column:
    return nearest(percent, AVAILABILITY_RATINGS)


def impact_level(percent: Column) -> Column:
    return nearest(percent, [(level, level) for level in IMPACT_LEVELS])


def missing_status(selected_rows: Column, previous_rows: Column) -> Column:
    """Which of the selected and the previous day holds no rows."""
    no_selected = or_zero(selected_rows) == 0
    no_previous = or_zero(previous_rows) == 0
    return (
        F.when(no_selected & no_previous, BOTH_MISSING)
        .when(no_previous, PREVIOUS_MISSING)
        .when(no_selected, SELECTED_MISSING)
        .otherwise(NONE_MISSING)
    )
