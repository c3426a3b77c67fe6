"""Work-order drafts derived from verdict cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions import text
from tritmarts.operators.calendar import adjust_due_dates
from tritmarts.operators.verdicts import said


def work_type(scenario: Column, sensor_type: Column) -> Column:
    exact = {f"{s}|{t}": w for s, t, w in fv.WORK_TYPES if t}
    general = {s: w for s, t, w in fv.WORK_TYPES if t is None}
    return F.coalesce(text.lookup(F.concat_ws("|", scenario, sensor_type), exact), text.lookup(scenario, general),
                      F.lit(fv.DEFAULT_WORK_TYPE))


def responsible(scenario: Column) -> Column:
    return F.coalesce(text.lookup(scenario, fv.RESPONSIBLE), F.lit(fv.DEFAULT_RESPONSIBLE))


def priority(probability: Column, scenario: Column, incubation: Column, cascade: Column) -> Column:
    """A cascade or a likely fire or intrusion is an emergency; slow decay can wait."""
    at_risk = scenario.isin(fv.FIRE, fv.INTRUSION) & (probability >= 0.6)
    slow = F.coalesce(incubation, F.lit(0)) > 7
    return (F.when(cascade | at_risk, F.lit(fv.EMERGENCY))
            .when(probability >= 0.85, F.lit(fv.HIGH))
            .when((probability >= 0.6) & slow, F.lit(fv.MEDIUM))
            .when(probability >= 0.6, F.lit(fv.HIGH))
            .otherwise(F.lit(fv.LOW)))


def due_date(day: Column, level: Column) -> Column:
    wait = None
    for name, days in fv.DUE_DAYS.items():
        wait = (F if wait is None else wait).when(level == name, F.lit(days))
    return F.date_add(day, wait)


def justification() -> Column:
    """Evidence with its time marks, limits of view and the precedent, as text."""
    signs = F.transform("evidence", lambda e: F.concat(
        F.when(F.length(e["since"]) > 10, said(F.replace(F.substring(e["since"], 1, 19), F.lit("T"), F.lit(" ")), " — "))
        .otherwise(F.lit("")), e["phrase"]))
    blind = F.transform("blind_spots", lambda b: said("— ", b))
    block = F.when(F.size(blind) > 0, said("\nОграничения наблюдаемости:\n", F.array_join(blind, "\n")))
    return F.concat_ws("\n", F.when(F.size(signs) > 0, F.array_join(signs, "\n")), block,
                       said("\n", F.nullif("precedent", F.lit(""))))


def drafts(verdicts: DataFrame, calendar: DataFrame) -> DataFrame:
    """Draft rows.  ``verdicts`` has the card columns, ``d`` and a ``cascade`` flag."""
    scenario = F.col("scenario")
    rows = (verdicts
            .withColumn("work_type", work_type(scenario, F.col("sensor_type")))
            .withColumn("priority", priority(F.col("probability"), scenario, F.col("incubation_days"), F.col("cascade")))
            .withColumn("due_date", due_date(F.col("d"), F.col("priority")))
            .withColumn("responsible", responsible(scenario))
            .withColumn("justification", justification()))
    rows = adjust_due_dates(rows, calendar, due="due_date")
    return rows.select(F.col("id").alias("verdict_id"), "d", "object_name", "picket", "work_type", "priority", "due_date",
                       "calendar_note", "responsible", "justification", "recommendation", "title", "probability",
                       "incubation_days", F.lit(fv.DRAFT_STATUS).alias("status"))


def summary_line() -> Column:
    where = said(F.coalesce("object_name", F.lit("")), F.coalesce(said(", ПК", F.col("picket").cast("string")), F.lit("")))
    note = F.col("calendar_note")
    tail = F.coalesce(said(" ", F.upper(F.substring(note, 1, 1)), F.lower(F.substring(note, F.lit(2), F.length(note))), "."), F.lit(""))
    return said(F.col("work_type"), " — ", where, ". Приоритет ", F.col("priority"), ", срок до ",
                F.date_format("due_date", "dd.MM.yyyy"), ", исполнитель: ", F.col("responsible"), ".", tail)
