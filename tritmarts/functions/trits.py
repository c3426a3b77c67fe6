"""Three-valued state algebra: deviation +1, unknown 0, normal -1.

The order is -1 < 0 < +1, so confirmation is the smaller and escalation the
larger of two states.  A missing state is an unknown one, never a normal one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tritmarts.fixed_values import (
    BOTH_NORMAL, CLASS_TRIT, CONFIRMED, DEVIATION, NORMAL, NOT_CONFIRMED, UNCONFIRMABLE, UNKNOWN)


def _known(t: Column) -> Column:
    return F.coalesce(t, F.lit(UNKNOWN))


def confirm(a: Column, b: Column) -> Column:
    return F.least(_known(a), _known(b))


def escalate(a: Column, b: Column) -> Column:
    return F.greatest(_known(a), _known(b))


def negate(t: Column) -> Column:
    return -_known(t)


def is_known(t: Column) -> Column:
    return _known(t) != UNKNOWN


def of_class(cls: Column) -> Column:
    """Class to trit; anything unlisted is unknown."""
    expr = None
    for name, trit in CLASS_TRIT.items():
        if trit != UNKNOWN:
            expr = (F if expr is None else expr).when(cls == name, F.lit(trit))
    return expr.otherwise(F.lit(UNKNOWN))


def of_zscore(z: Column, threshold: float = 2.0) -> Column:
    """Two-sided robust z-score; a missing score is unknown."""
    return (F.when(z.isNull() | F.isnan(z), F.lit(UNKNOWN))
            .when(F.abs(z) >= threshold, F.lit(DEVIATION))
            .otherwise(F.lit(NORMAL)))


def of_staleness(age_hours: Column, interval_hours: Column, factor: float = 10.0) -> Column:
    """Silence longer than the usual interval times the factor is a deviation."""
    unknown = (age_hours.isNull() | interval_hours.isNull() | F.isnan(age_hours)
               | F.isnan(interval_hours) | (interval_hours <= 0))
    return (F.when(unknown, F.lit(UNKNOWN))
            .when(age_hours > interval_hours * factor, F.lit(DEVIATION))
            .otherwise(F.lit(NORMAL)))


def group_states(df: DataFrame, keys: list[str], trit: str = "trit") -> DataFrame:
    """Confirmation, escalation and observability share of each group."""
    t = _known(F.col(trit))
    return df.groupBy(*keys).agg(
        F.min(t).alias("trit_all"),
        F.max(t).alias("trit_any"),
        F.coalesce(F.avg(F.when(t != UNKNOWN, 1.0).otherwise(0.0)), F.lit(0.0)).alias("observability"))


def confirmation_sentence(name_a: Column, a: Column, name_b: Column, b: Column) -> Column:
    """One sentence for a pair of named states."""
    a, b = _known(a), _known(b)
    both = confirm(a, b)
    b_blind, b_quiet = b == UNKNOWN, b == NORMAL
    return (
        F.when(both == DEVIATION, F.format_string(CONFIRMED, name_a, name_b))
        .when(both == UNKNOWN, F.format_string(
            UNCONFIRMABLE,
            F.when(b_blind, name_a).otherwise(name_b),
            F.when(b_blind, name_b).otherwise(name_a)))
        .when(escalate(a, b) == DEVIATION, F.format_string(
            NOT_CONFIRMED,
            F.when(b_quiet, name_a).otherwise(name_b),
            F.when(b_quiet, name_b).otherwise(name_a)))
        .otherwise(F.format_string(BOTH_NORMAL, name_a, name_b)))
