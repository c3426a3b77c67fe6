"""Numeric parsing of raw journal values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tritmarts.fixed_values import NUMBER_PATTERN
from tritmarts.settings import Measurement


def to_number(raw: Column) -> Column:
    """Number in a raw value, decimal comma allowed, NULL when it is not one.

    The pattern guards the cast because Spark also reads Java suffixes ("5d").
    """
    dotted = F.replace(raw, F.lit(","), F.lit("."))
    return F.when(dotted.rlike(NUMBER_PATTERN), dotted.try_cast("double"))


def measured(raw: Column, m: Measurement = Measurement()) -> Column:
    """A real reading: in range and not one of the device error codes."""
    value = to_number(raw)
    return F.when(value.between(m.low, m.high) & ~value.isin(list(m.sentinels)), value)


def epoch_second(day: Column, second_of_day: Column) -> Column:
    return F.unix_date(day).cast("bigint") * 86400 + second_of_day


def clock(second_of_day: Column) -> Column:
    """HH:MM:SS text of a second of the day; NULL stays NULL."""
    s = second_of_day.cast("int")
    return F.when(s.isNotNull(), F.format_string(
        "%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60))


def moment(day: Column, second_of_day: Column) -> Column:
    """ISO date-time text; NULL when the second is unknown."""
    return F.concat(day.cast("string"), F.lit("T"), clock(second_of_day))
