"""Calendar dimension: non-working days, breaks, risk, due dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tritmarts import fixed_values as fv

LONG_BREAK = 3
LOOK_AHEAD = 14
#: days before the first one that a break reaching into it may begin
MARGIN = 45
#: every year has a long break, so this many days behind the last one always hold the next
FORWARD = 400


def _holiday(d: Column) -> Column:
    out = None
    for month, day, name in fv.HOLIDAYS:
        out = (F if out is None else out).when((F.month(d) == month) & (F.dayofmonth(d) == day), F.lit(name))
    return out


def calendar_dim(spark: SparkSession, first: str, last: str) -> DataFrame:
    """The calendar from ``first`` to ``last``."""
    return _calendar(spark.range(1).select(F.lit(first).cast("date").alias("first"), F.lit(last).cast("date").alias("last")))


def calendar_of(rows: DataFrame, day: str = "d", due: str = "due") -> DataFrame:
    """The calendar from the first ``day`` to the last ``due`` (or day) of ``rows``, an aggregate of one row."""
    return _calendar(rows.agg(F.min(day).alias("first"), F.greatest(F.max(day), F.max(due)).alias("last"))
                     .where("first is not null"))


def _calendar(edge: DataFrame) -> DataFrame:
    """One row per day with its break, the next long break and the risk factor.

    Breaks are runs of consecutive non-working days: day number minus its rank
    among non-working days is constant inside a run.  The next long break is the first one
    at or after the day, however far.  The table has one row per calendar day, so
    its unpartitioned windows are small.
    """
    d = F.col("d")
    days = edge.select("first", "last", F.explode(F.sequence(
        F.date_sub("first", MARGIN), F.date_add("last", FORWARD), F.expr("interval 1 day"))).alias("d"))
    days = (days.withColumn("n", F.unix_date("d")).withColumn("holiday", _holiday(d))
            .withColumn("is_weekend", F.dayofweek("d").isin(1, 7))
            .withColumn("is_nonworking", F.col("holiday").isNotNull() | F.col("is_weekend")))
    off = F.sum(F.col("is_nonworking").cast("int")).over(Window.orderBy("n"))
    days = days.withColumn("run", F.when(F.col("is_nonworking"), F.col("n") - off))
    length = F.count(F.lit(1)).over(Window.partitionBy("run"))
    days = days.withColumn("break_length", F.when(F.col("is_nonworking"), length).otherwise(0))
    long = F.col("break_length") >= LONG_BREAK
    ahead = Window.orderBy("n").rangeBetween(0, LOOK_AHEAD)
    far = Window.orderBy("n").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    days = (days
            .withColumn("days_to_break", F.min(F.when(long, F.col("n"))).over(ahead) - F.col("n"))
            .withColumn("next_break", F.min(F.when(long, F.struct("d", "break_length"))).over(far)))
    name, span, soon = F.col("holiday"), F.col("break_length"), F.col("days_to_break")
    month, day, special = fv.SPECIAL_DAY
    is_special = (F.month(d) == month) & (F.dayofmonth(d) == day)
    near = soon.between(1, 3)

    def said(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    rules = [
        (is_special, 1.35, F.lit(f"{special} — объекты без постоянного присмотра, бригад на линии меньше обычного")),
        (name.isNotNull() & long, 1.30,
         said(name, ", ", span, "-й день длинных выходных — присутствие персонала на объектах пониженное")),
        (name.isNotNull(), 1.20, said(name, " — нерабочий день, персонала на объектах меньше")),
        (F.col("is_weekend") & long, 1.15, said("длинные выходные (", span, " нерабочих дня подряд)")),
        (F.col("is_weekend"), 1.10, F.lit("выходной день — плановых работ на объекте не ведётся")),
        (near, 1.0, said("через ", soon, " сут начинаются длинные выходные — работы разумно закрыть до их начала")),
    ]
    factor, note = None, None
    for cond, k, words in rules:
        factor = (F if factor is None else factor).when(cond, F.lit(k))
        note = (F if note is None else note).when(cond, words)
    return (days.withColumn("multiplier", factor.otherwise(F.lit(1.0))).withColumn("note", note).filter(d.between(F.col("first"), F.col("last")))
            .select("d", "holiday", "is_weekend", "is_nonworking", "break_length", "days_to_break",
                    F.col("next_break.d").alias("next_break"), F.col("next_break.break_length").alias("next_break_length"),
                    "multiplier", "note"))


def adjust_due_dates(rows: DataFrame, calendar: DataFrame, day: str = "d", due: str = "due") -> DataFrame:
    """Pull a due date before the first long break that starts in [day, due].

    The next break of every day is in the calendar, so this is an equi join.  A
    row whose day the calendar does not cover fails the job; a null day stays as it is.
    """
    nxt = calendar.select(F.col("d").alias(day), "next_break", "next_break_length")
    missing = F.col(day).isNotNull() & F.col("next_break").isNull()
    fail = F.raise_error(F.concat(F.lit("the calendar does not cover "), F.col(day).cast("string"))).cast("date")
    hit = F.col("next_break") <= F.col(due)
    moved = F.date_sub("next_break", 1)
    note = F.concat(F.lit("срок сдвинут на "), F.date_format(moved, "dd.MM"), F.lit(": далее следуют "),
                    F.col("next_break_length").cast("string"), F.lit(" нерабочих дня подряд"))
    return (rows.join(nxt, day, "left")
            .withColumn("calendar_note", F.when(hit, note))
            .withColumn(due, F.when(missing, fail).when(hit, F.greatest(moved, F.col(day))).otherwise(F.col(due)))
            .drop("next_break", "next_break_length"))
