"""Feature matrix on the label grid and its wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions import text
from tritmarts.functions.written import written
from tritmarts.operators.marts import failures

NEVER = 9999


def dense_series(y: DataFrame, fact: DataFrame, first: str | None = None,
                 last: str | None = None) -> DataFrame:
    """Label rows with the facts of the day; a day without rows is zeros.

    A period given here cuts the history the windows see, not just the output.
    """
    if first and last:
        y = y.filter(F.col("d").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    seen = fact.select("channel_id", "d", "n_ev", failures().alias("n_fault"), "n_undefined",
                       "trit_day", F.lit(1).alias("was_active"))
    zero = F.lit(0)
    return (y.join(seen, ["channel_id", "d"], "left")
            .select("channel_id", "d", "y",
                    *[F.coalesce(c, zero).alias(c) for c in
                      ("n_ev", "n_fault", "n_undefined", "was_active", "trit_day")]))


def _by_day():
    return Window.partitionBy("channel_id").orderBy("d")


def rolling_sums(dense: DataFrame, beside: dict[str, Column] | None = None) -> DataFrame:
    """Trailing sums over 7, 30 and 90 grid rows, the current day included.

    Spark re-adds a sliding frame for every row, so each sum is the difference
    of two running totals: one incremental pass and a lag, whatever the width.
    Columns ``beside`` look back over the same rows in the same pass.
    """
    beside = beside or {}
    counted = {
        "ev": F.col("n_ev"), "active": F.col("was_active"), "fault": F.col("n_fault"),
        "undefined": F.col("n_undefined"), "dev": F.when(F.col("trit_day") == 1, 1).otherwise(0),
        "quiet": F.when(F.col("was_active") == 0, 1).otherwise(0),
        "fault_days": F.when(F.col("n_fault") > 0, 1).otherwise(0),
    }
    windows = {
        "ev_7d": ("ev", 7), "active_days_7d": ("active", 7), "fault_ev_7d": ("fault", 7),
        "undefined_ev_7d": ("undefined", 7), "dev_days_7d": ("dev", 7), "unknown_days_7d": ("quiet", 7),
        "fault_days_30d": ("fault_days", 30), "ev_90d": ("ev", 90), "fault_90d": ("fault", 90),
        "active_days_90d": ("active", 90),
    }
    so_far = _by_day().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = dense.select("*", *[F.sum(c.cast("bigint")).over(so_far).alias(f"_{n}") for n, c in counted.items()],
                          *[c.alias(n) for n, c in beside.items()])
    return totals.select(*dense.columns, *beside, *[
        (F.col(f"_{n}") - F.coalesce(F.lag(f"_{n}", rows).over(_by_day()), F.lit(0))).alias(out)
        for out, (n, rows) in windows.items()])


def _last_days() -> dict[str, Column]:
    """The last day a channel spoke and the last on which it broke, so far."""
    so_far = _by_day().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return {"_spoke": F.max(F.when(F.col("was_active") == 1, F.col("d"))).over(so_far),
            "_broke": F.max(F.when(F.col("n_fault") > 0, F.col("d"))).over(so_far)}


def _since(rows: DataFrame) -> DataFrame:
    return (rows.withColumn("silence_days", F.coalesce(F.datediff("d", "_spoke"), F.lit(0)))
            .withColumn("days_since_fault", F.coalesce(F.datediff("d", "_broke"), F.lit(NEVER)))
            .drop("_spoke", "_broke"))


def streaks(series: DataFrame) -> DataFrame:
    """Days of silence and days since the last fault (never: 9999)."""
    return _since(series.select("*", *[c.alias(n) for n, c in _last_days().items()]))


def neighbour_shares(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Share of a point's active channels in deviation and unknown, per day."""
    def share(value: int) -> Column:
        return F.avg(F.when(F.col("trit_day") == value, 1.0).otherwise(0.0))

    place = dim.filter(F.col("picket").isNotNull()).select("channel_id", "object_id", "picket")
    return (fact.select("channel_id", "d", "trit_day").join(place, "channel_id")
            .groupBy("object_id", "picket", "d")
            .agg(share(fv.DEVIATION).alias("dev_share"), share(fv.UNKNOWN).alias("silent_share")))


def controller_shares(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Share of a controller's active channels in failure, per day."""
    return (fact.select("channel_id", "d", failures().alias("f"))
            .join(dim.select("channel_id", "tag_base"), "channel_id")
            .groupBy("tag_base", "d")
            .agg(F.avg(F.when(F.col("f") > 0, 1.0).otherwise(0.0)).alias("base_failed_share")))


_GRID = {"y": "int", "n_ev": "bigint", "n_fault": "bigint", "n_undefined": "bigint", "was_active": "int", "trit_day": "int",
         "dev_share": "double", "silent_share": "double", "base_failed_share": "double"}


def _grid_rows(y: DataFrame, fact: DataFrame, dim: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """The dense series of the grid with the shares of point and controller, partitioned by channel.

    The shares are written, so that the planner knows their size: small ones are sent to the grid rows,
    large ones meet them by point or controller and day, while the rows are still a channel, a day and a label.
    """
    if first and last:
        y = y.filter(F.col("d").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    near = written(neighbour_shares(fact, dim), "neighbour_shares")
    wired = written(controller_shares(fact, dim), "controller_shares")
    placed = (y.select("channel_id", "d", "y").join(dim.select("channel_id", "object_id", "picket", "tag_base"), "channel_id", "left")
              .join(near, ["object_id", "picket", "d"], "left").join(wired, ["tag_base", "d"], "left"))
    seen = fact.select("channel_id", "d", "n_ev", failures().alias("n_fault"), "n_undefined", "trit_day", F.lit(1).alias("was_active"))
    kinds = {**_GRID, "y": y.schema["y"].dataType.simpleString()}
    parts = [p.select("channel_id", "d", *[(F.col(c) if c in p.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
             for p in (placed, seen)]
    dealt = parts[0].unionByName(parts[1]).repartition("channel_id")
    folded = dealt.groupBy("channel_id", "d").agg(*[F.max(c).alias(c) for c in kinds]).filter("y IS NOT NULL")
    return folded.na.fill(0, ["n_ev", "n_fault", "n_undefined", "was_active", "trit_day"])


def feature_matrix(y: DataFrame, fact: DataFrame, dim: DataFrame, profile: DataFrame,
                   domains: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The 20 model columns.

    Labels with the shares of their point and controller, and facts, are narrow rows of
    (channel, day).  They are dealt by channel once and folded there; the windows and the
    join to the channel's place need no further exchange of the grid.
    """
    place = (dim.select("channel_id", "object_id", "picket")
             .join(profile.select("channel_id", "first_day"), "channel_id")
             .join(domains.select("object_id", "picket", F.col("n_channels").alias("domain_size")),
                   ["object_id", "picket"], "left").select("channel_id", "first_day", "domain_size"))
    s = _since(rolling_sums(_grid_rows(y, fact, dim, first, last).join(place, "channel_id"), _last_days()))

    def num(name: str) -> Column:
        return F.col(name).cast("double")

    def ratio(part: Column, whole: Column) -> Column:
        return part / F.nullif(whole, F.lit(0.0))

    columns = {
        "ev_7d": num("ev_7d"),
        "ev_ratio_7d": ratio(num("ev_7d"), num("ev_90d") / 90.0 * 7.0),
        "active_days_7d": num("active_days_7d"),
        "silence_days": num("silence_days"),
        "silence_ratio": ratio(num("silence_days"), ratio(F.lit(90.0), num("active_days_90d"))),
        "fault_ev_7d": num("fault_ev_7d"),
        "fault_days_30d": num("fault_days_30d"),
        "fault_ratio_90d": ratio(num("fault_ev_7d"), num("fault_90d") / 90.0 * 7.0),
        "days_since_fault": F.least(num("days_since_fault"), F.lit(float(NEVER))),
        "undefined_ev_7d": num("undefined_ev_7d"),
        "undefined_share_7d": ratio(num("undefined_ev_7d"), num("ev_7d")),
        "dev_days_7d": num("dev_days_7d"),
        "unknown_days_7d": num("unknown_days_7d"),
        "domain_size": F.coalesce(num("domain_size"), F.lit(1.0)),
        "domain_dev_share_7d": F.coalesce("dev_share", F.lit(0.0)),
        "domain_silent_share": F.coalesce("silent_share", F.lit(0.0)),
        "base_failed_share_7d": F.coalesce("base_failed_share", F.lit(0.0)),
        "channel_age_days": F.datediff("d", "first_day").cast("double"),
        "month": F.month("d").cast("double"),
        "is_weekend": F.dayofweek("d").isin(1, 7).cast("double"),
    }
    return s.select("channel_id", "d", "y", *[columns[n].alias(n) for n in fv.FEATURE_NAMES])


# ---- wording ----------------------------------------------------------------

def long_form(rows: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """(keys, feature, value): the matrix turned on its side."""
    names = names or fv.FEATURE_NAMES
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])
    return rows.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.feature", "c.value")


def is_supported(feature: Column, amounts: dict[str, Column]) -> Column:
    """Relative evidence needs a minimum absolute amount behind it."""
    ok = None
    for name, (source, floor) in fv.MIN_SUPPORT.items():
        ok = (F if ok is None else ok).when(feature == name, amounts[source] >= floor)
    return ok.otherwise(F.lit(True))


def phrase(feature: Column, value: Column, baseline: Column | None = None) -> Column:
    """Sentence about one feature value."""
    parts = {
        "whole": F.coalesce(text.whole(value), F.lit("nan")),
        "tenth": F.coalesce(text.tenth(value), F.lit("nan")),
        "percent": F.coalesce(text.percent(value), F.lit("nan%")),
        "base": text.whole(baseline) if baseline is not None else F.lit("0"),
        "days": text.agree(value, fv.DAY_FORMS), "channels": text.agree(value, fv.CHANNEL_FORMS),
    }
    special = {
        "days_since_fault": (value < 1, fv.FAULT_TODAY),
        "silence_days": (value < 1, fv.LINKED_TODAY),
        "is_weekend": (value == 0, fv.WORKING_DAY),
    }
    out = None
    for name, template in fv.FEATURE_PHRASES.items():
        said = text.fill(template, parts)
        if name in special:
            when, instead = special[name]
            said = F.when(when, F.lit(instead)).otherwise(said)
        out = (F if out is None else out).when(feature == name, said)
    return out.otherwise(F.concat(feature, F.lit(" = "), value.cast("string")))
