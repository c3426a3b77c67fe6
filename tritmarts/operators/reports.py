"""Registers, summaries and dashboards over verdict rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions.attach import with_row


def _blind() -> Column:
    return F.coalesce(F.size("blind_spots"), F.lit(0)) > 0


def verdict_register(verdicts: DataFrame, decisions: DataFrame, reasons: DataFrame, users: DataFrame) -> DataFrame:
    """Verdicts with the decision taken, its reason and who took it."""
    return (verdicts
            .join(decisions.select(F.col("verdict_id").alias("id"), "action", "reason_id", "user_id", "decided_at"), "id", "left")
            .join(reasons.select("reason_id", F.col("title").alias("reason_title")), "reason_id", "left")
            .join(users.select("user_id", "full_name"), "user_id", "left"))


def summary(register: DataFrame) -> DataFrame:
    """Totals by scenario and status, closed ones, share dropped as non-essential."""
    closed = F.col("status") == fv.STATUS_CLOSED
    idle = closed & F.col("reason_title").isin(fv.NON_ESSENTIAL_REASONS)
    folded = register.groupBy("scenario", "status").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(closed).alias("closed"), F.count_if(idle).alias("idle"))
    total = folded.agg(F.sum("n").alias("a"), F.sum("closed").alias("b"), F.sum("idle").alias("c"))
    lines = F.array(*[F.struct(F.lit(k).alias("indicator"), v.cast("double").alias("value")) for k, v in {
        "total": F.col("a"), "closed": F.col("b"), "non_essential": F.col("c"),
        "non_essential_share": F.col("c") / F.nullif("b", F.lit(0))}.items()])
    overall = total.select(F.explode(lines).alias("x")).select("x.indicator", "x.value")

    def by(column: str) -> DataFrame:
        return (folded.groupBy(column).agg(F.sum("n").cast("double").alias("value"))
                .select(F.concat(F.lit(column + ": "), F.col(column)).alias("indicator"), "value"))

    return overall.unionByName(by("scenario")).unionByName(by("status"))


def observability(register: DataFrame) -> DataFrame:
    """Objects whose verdicts have limits of view, with their share."""
    per = register.groupBy("object_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(_blind()).alias("blind"))
    return per.filter("blind > 0").withColumn("share", F.col("blind") / F.col("total"))


def work_order_register(orders: DataFrame, users: DataFrame, limit: int | None = None) -> DataFrame:
    """Drafts with their author, nearest due date first, undated last."""
    rows = orders.join(users.select(F.col("user_id").alias("author_id"), "full_name"), "author_id", "left") \
        .orderBy(F.col("due_date").asc_nulls_last(), F.col("created_at").desc())
    return rows.limit(limit) if limit else rows


def verdict_feed(verdicts: DataFrame, status: str | None = None, scenario: str | None = None,
                 limit: int | None = 100) -> DataFrame:
    """The riskiest verdicts, optionally of one status or scenario."""
    if status:
        verdicts = verdicts.filter(F.col("status") == status)
    if scenario:
        verdicts = verdicts.filter(F.col("scenario") == scenario)
    rows = verdicts.orderBy(F.col("probability").desc(), F.col("created_at").desc(), F.col("id"))
    return rows.limit(limit) if limit else rows


def visible_to(verdicts: DataFrame, users: DataFrame, assignments: DataFrame, user_id: int) -> DataFrame:
    """Verdicts one user may see: assigned objects only.

    A global role, or a user without assignments, sees everything.
    """
    mine = F.col("user_id") == user_id
    own = assignments.filter(mine).select("object_id").distinct()
    scope = with_row(users.filter(mine).agg(F.coalesce(F.bool_or("is_global"), F.lit(False)).alias("_global")),
                     own.agg((F.count(F.lit(1)) == 0).alias("_none")))
    rows = with_row(verdicts.join(own.withColumn("_own", F.lit(True)), "object_id", "left"), scope)
    return rows.filter(F.col("_global") | F.col("_none") | F.col("_own")).select(verdicts.columns)


def visible_counts(verdicts: DataFrame, users: DataFrame, assignments: DataFrame) -> DataFrame:
    """How many verdicts each user may see, from counts per object."""
    per_object = verdicts.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
    own = (assignments.select("user_id", "object_id").distinct().join(per_object, "object_id", "left")
           .groupBy("user_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("own")))
    rows = with_row(users.select("user_id", "is_global"), per_object.agg(F.sum("n").alias("total")))
    rows = rows.join(own, "user_id", "left")
    free = F.col("is_global") | F.col("own").isNull()
    return rows.select("user_id", F.when(free, F.col("total")).otherwise(F.col("own")).alias("visible"))


def queue_counters(verdicts: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("object_name", F.lit("")), F.lit(fv.NO_OBJECT))
    per = verdicts.groupBy(name.alias("o")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("probability") >= 0.8).alias("h"),
        F.count_if(F.col("status") == fv.STATUS_NEW).alias("w"), F.count_if(_blind()).alias("b"))
    return per.agg(F.count(F.lit(1)).alias("objects"), F.sum("n").alias("verdicts"), F.sum("h").alias("high_risk"),
                   F.sum("w").alias("new"), F.sum("b").alias("limited_view"))


def object_scenario_matrix(verdicts: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("object_name", F.lit("")), F.lit(fv.NO_OBJECT_SHORT))
    wide = (verdicts.groupBy(name.alias("object_name")).pivot("scenario", list(fv.SCENARIO_TITLE))
            .agg(F.count(F.lit(1))).na.fill(0))
    total = sum((F.col(s) for s in fv.SCENARIO_TITLE), F.lit(0))
    return wide.withColumn("total", total)


def incubation_histogram(verdicts: DataFrame) -> DataFrame:
    """Counts per incubation bucket; empty buckets are shown as zero."""
    days = F.col("incubation_days")
    counts = verdicts.agg(*[F.count_if((days >= a) & (days <= b) if b is not None else days >= a).alias(f"_{i}")
                            for i, (a, b, _) in enumerate(fv.INCUBATION_BUCKETS)])
    rows = F.array(*[F.struct(F.lit(label).alias("bucket"), F.col(f"_{i}").alias("n"))
                     for i, (_, _, label) in enumerate(fv.INCUBATION_BUCKETS)])
    return counts.select(F.explode(rows).alias("x")).select("x.bucket", "x.n")


def linear_scheme(verdicts: DataFrame) -> DataFrame:
    """Verdicts along the unrolled axis of their object, as a relative position."""
    rows = verdicts.filter("picket IS NOT NULL AND object_name <> ''")
    span = rows.groupBy("object_name").agg(F.min("picket").alias("lo"), F.max("picket").alias("hi"))
    at = (F.col("picket") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    return rows.join(span, "object_name").withColumn("position", at)
