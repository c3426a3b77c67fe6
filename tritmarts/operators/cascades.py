"""Cascades: many signs within two minutes of the first one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tritmarts.functions import text
from tritmarts.functions.ordering import with_neighbour
from tritmarts.functions.written import written
from tritmarts.operators.verdicts import said
from tritmarts.settings import Cards

SIGN_FORMS = ("признак", "признака", "признаков")
SECOND = 1_000_000
DAY = 86400 * SECOND
#: a long island is walked in pieces of this length at once
BLOCK = 3600 * SECOND
_PIECE = ["object_name", "island", "block"]


def moment(ts: Column) -> Column:
    """Microseconds of an ISO stamp with optional fraction and zone; NULL for a bare date and for anything else."""
    return F.when(F.length(ts) > 10, F.unix_micros(F.try_to_timestamp(ts)))


def iso(us: Column) -> Column:
    """ISO text in UTC, with a fraction only where there is one."""
    at = F.timestamp_micros(us)
    return F.when(us % SECOND == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def _islands(moments: DataFrame, window: int) -> DataFrame:
    """Start of the island each moment belongs to; islands are over ``window`` apart.

    The running maximum of break points is taken inside a day and carried over
    days, never over an object's whole history at once.
    """
    rows = with_neighbour(moments.withColumn("_day", F.floor(F.col("us") / DAY)), ["object_name"], "_day", ["us"], ["us"])
    gap = F.col("us") - F.col("prev.us")
    rows = rows.withColumn("_cut", F.when(F.col("prev").isNull() | (gap > window), F.col("us"))).drop("prev")
    before = (Window.partitionBy("object_name").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    carried = (rows.groupBy("object_name", "_day").agg(F.max("_cut").alias("_c"))
               .select("object_name", "_day", F.max("_c").over(before).alias("_carried")))
    inside = (Window.partitionBy("object_name", "_day").orderBy("us")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.withColumn("_in", F.max("_cut").over(inside)).join(carried, ["object_name", "_day"])
            .select("object_name", "us", F.coalesce("_in", "_carried").alias("island")))


def _walk(us: np.ndarray, start: int, window: int) -> np.ndarray:
    """Anchors of the sorted moments from place ``start`` on; earlier ones get -1."""
    anchor = np.full(len(us), -1, np.int64)
    while start < len(us):
        stop = int(np.searchsorted(us, us[start] + window, side="right"))
        anchor[start:stop] = us[start]
        start = stop
    return anchor


def _exits(window: int, block: int):
    """For every moment of a block at which the walk can enter it: the last anchor before the walk leaves."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        us = np.sort(pdf["us"].to_numpy())
        after = np.searchsorted(us, us + window, side="right")
        last = us.copy()
        for i in range(len(us) - 1, -1, -1):
            if after[i] < len(us):
                last[i] = last[after[i]]
        # an earlier anchor reaches at most one window into the block
        n = max(1, int(np.searchsorted(us, us[0] - us[0] % block + window, side="right")) + 1)
        return pdf.iloc[[0], :][_PIECE].merge(pd.DataFrame({"entry": us[:n], "last": last[:n]}), how="cross")
    return run


def _with_next(exits: DataFrame, window: int) -> DataFrame:
    """Where the walk goes on: the first entry of the next block beyond the window of the last anchor, if any.

    Last anchors and the entries of the block behind them stand in one order, and the nearest
    entry is carried back from its end.
    """
    asked = exits.select("object_name", "island", (F.col("block") + 1).alias("block"), (F.col("last") + window).alias("at"),
                         "entry", "last", F.lit(None).cast("long").alias("opens"))
    opened = exits.select(*_PIECE, F.col("entry").alias("at"), F.lit(None).cast("long").alias("entry"),
                          F.lit(None).cast("long").alias("last"), F.col("entry").alias("opens"))
    beyond = Window.partitionBy(*_PIECE).orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    return (asked.union(opened).withColumn("next", F.min("opens").over(beyond)).filter("entry IS NOT NULL")
            .select("object_name", "island", (F.col("block") - 1).alias("block"), "entry", "last", "next"))


def _entered(exits: DataFrame, window: int) -> DataFrame:
    """The entries that the walk of each island really takes, one a block.

    Every entry leads to one of the next block.  From the island's first moment the walk is
    found by doubling: what is reached in 2**k steps is joined to steps of 2**k, which are
    then joined to themselves, so a run of any number of blocks takes logarithmically many
    rounds of equi joins and is never in one group.
    """
    island = ["object_name", "island"]
    nodes = written(_with_next(exits, window), "cascade_entries")
    reached = nodes.filter("entry = island").select(*island, "entry")
    steps = nodes.filter("next IS NOT NULL").select(*island, "entry", F.col("next").alias("to"))
    while True:
        more = written(reached.join(steps, [*island, "entry"]).select(*island, F.col("to").alias("entry")), "cascade_reached")
        if more.isEmpty():
            return nodes.drop("next").join(reached, [*island, "entry"], "left_semi")
        reached = reached.union(more)
        on = steps.select(*island, F.col("entry").alias("to"), F.col("to").alias("end"))
        steps = written(steps.join(on, [*island, "to"]).select(*island, "entry", F.col("end").alias("to")), "cascade_steps")


def _anchored(window: int):
    """Anchors of a block's moments; what stands before the entry belongs to the anchor the walk came with."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        us = np.sort(pdf["us"].to_numpy())
        entry, carry = pdf["entry"].iloc[0], pdf["carry"].iloc[0]
        anchor = _walk(us, len(us) if pd.isna(entry) else int(np.searchsorted(us, int(entry))), window)
        anchor[anchor < 0] = -1 if pd.isna(carry) else int(carry)
        return pd.DataFrame({"object_name": pdf["object_name"].iloc[0], "us": us, "anchor": anchor})
    return run


def _anchored_groups(signs: DataFrame, cfg: Cards) -> tuple[DataFrame, DataFrame]:
    """(object_name, us, anchor) of every moment, and the groups that are cascades."""
    window = cfg.cascade_seconds * SECOND
    block = max(BLOCK, 2 * window)
    timed = signs.withColumn("us", moment(F.col("ts"))).filter("us IS NOT NULL")
    folded = written(timed.groupBy("object_name", "us", "picket").agg(F.count(F.lit(1)).alias("n")), "signs_by_moment")
    moments = written(_islands(folded.select("object_name", "us").distinct(), window), "sign_islands")
    ends = moments.groupBy("object_name", "island").agg(F.max("us").alias("last"))
    placed = moments.join(ends, ["object_name", "island"])
    is_long = F.col("last") - F.col("island") > window
    short = placed.filter(~is_long).select("object_name", "us", F.col("island").alias("anchor"))
    pieces = written(placed.filter(is_long).select(
        "object_name", "island", F.floor(F.col("us") / block).alias("block"), "us"), "cascade_pieces")
    exits = pieces.groupBy(*_PIECE).applyInPandas(_exits(window, block), "object_name string, island long, block long, entry long, last long")
    entered = written(_entered(exits, window), "cascade_walk")
    carried = entered.select("object_name", "island", (F.col("block") + 1).alias("block"), F.col("last").alias("carry"))
    entries = entered.select(*_PIECE, "entry").join(carried, _PIECE, "full")
    walked = pieces.join(entries, _PIECE).groupBy(*_PIECE).applyInPandas(
        _anchored(window), "object_name string, us long, anchor long")
    anchors = short.unionByName(walked)
    groups = (folded.join(anchors, ["object_name", "us"]).groupBy("object_name", "anchor")
              .agg(F.sum("n").alias("n_signs"), ((F.max("us") - F.col("anchor")) / SECOND).alias("span_seconds"),
                   F.sort_array(F.collect_set("picket")).alias("pickets"))
              .filter((F.col("n_signs") >= cfg.cascade_points) & (F.size("pickets") >= cfg.cascade_pickets)))
    return anchors, groups


def moments_in_cascades(signs: DataFrame, cfg: Cards = Cards()) -> DataFrame:
    """(object_name, us): the moments of signs that belong to a cascade."""
    anchors, groups = _anchored_groups(signs, cfg)
    return anchors.join(groups.select("object_name", "anchor"), ["object_name", "anchor"], "left_semi").select("object_name", "us")


def detect_cascades(signs: DataFrame, cfg: Cards = Cards()) -> DataFrame:
    """Greedy groups anchored at their first sign, over (object_name, ts, picket).

    Any ISO stamp counts to the microsecond, zones are brought to UTC and other texts are passed over.
    Signs are folded to distinct moments and cut into islands.  An island no
    longer than the window is one group already.  The walk over a longer one is cut
    into hours: an anchor reaches at most one window into an hour, so only the moments
    there can be entered; all hours find the exit of every such entry at once, doubling tells
    which entries are real, and all hours place their anchors.
    """
    _, found = _anchored_groups(signs, cfg)
    at = F.timestamp_micros("anchor")
    a, b = F.element_at("pickets", 1), F.element_at("pickets", -1)
    words = said(text.counted(F.col("n_signs"), SIGN_FORMS), " на ", F.size("pickets").cast("string"),
                 " точках возникли за ", text.whole(F.col("span_seconds")), " с (", F.date_format(at, "dd.MM HH:mm:ss"),
                 "), отрезок ПК", a.cast("string"), "–ПК", b.cast("string"), " (",
                 ((b - a) * cfg.picket_meters).cast("string"),
                 " м). Похоже на каскад по питающей линии, а не на независимые отказы")
    return found.select("object_name", iso(F.col("anchor")).alias("at"), "n_signs",
                        "span_seconds", "pickets", words.alias("text"))
