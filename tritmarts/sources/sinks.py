"""Verdict and geometry exports, written in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions.attach import with_row
from tritmarts.operators.verdicts import said

BOM = "\ufeff"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def flat_verdicts(cards: DataFrame) -> DataFrame:
    """Fifteen text columns per verdict, lists joined by "; "."""
    joined = {
        "probability": F.format_string("%.4f", F.bround("probability", 4)),
        "evidence": F.array_join(F.transform("evidence", lambda e: e["phrase"]), "; "),
        "blind_spots": F.array_join("blind_spots", "; "),
    }
    return cards.select(*[joined.get(k, _text(k)).alias(k) for k, _ in fv.FLAT_COLUMNS])


def _lines(df: DataFrame, header: list[str], sep: str = ";") -> DataFrame:
    """A title line with a byte-order mark, then one line per row.

    The title comes first in the first file, so joining the files in name
    order gives one valid document.
    """
    body = df.select(F.to_csv(F.struct(*df.columns), {"sep": sep, "escape": '"', "emptyValue": "", "nullValue": ""}).alias("value"))
    title = df.sparkSession.range(0, 1, 1, 1).select(F.lit(BOM + sep.join(header)).alias("value"))
    return title.union(body)


def write_lines(lines: DataFrame, path: str, line_end: str = "\r\n", compression: str = "none") -> str:
    lines.write.mode("overwrite").option("lineSep", line_end).option("compression", compression).text(path)
    return path


def verdict_csv(cards: DataFrame) -> DataFrame:
    return _lines(flat_verdicts(cards), [t for _, t in fv.FLAT_COLUMNS])


def verdict_xml(cards: DataFrame) -> DataFrame:
    """Rows shaped for the XML writer: attributes start with an underscore."""
    items = F.transform("evidence", lambda e: F.struct(
        e["feature"].alias("_feature"), F.format_string("%.6f", e["contribution"]).alias("_contribution"),
        e["since"].alias("_since"), e["phrase"].alias("_VALUE")))
    marks = F.transform("timeline", lambda m: F.struct(m["ts"].alias("_at"), m["kind"].alias("_kind"), m["text"].alias("_VALUE")))
    return cards.select(
        F.col("id").alias("_id"), _text("created_at").alias("created_at"), _text("scenario").alias("scenario"),
        _text("object_name").alias("object_name"), _text("picket").alias("picket"), _text("channel_id").alias("channel_id"),
        F.format_string("%.4f", F.bround("probability", 4)).alias("probability"),
        _text("horizon_hours").alias("horizon_hours"), _text("status").alias("status"), "title", "first_sign_at",
        F.col("incubation_days").cast("string").alias("incubation_days"), "recommendation",
        F.when(F.size(items) > 0, F.struct(items.alias("item"))).alias("evidence"),
        F.when(F.size("blind_spots") > 0, F.struct(F.col("blind_spots").alias("item"))).alias("blind_spots"),
        F.when(F.size(marks) > 0, F.struct(marks.alias("mark"))).alias("timeline"))


def write_xml(cards: DataFrame, path: str, compression: str = "none") -> str:
    """One document: head with the number of verdicts, a line per verdict, tail; part files join in name order."""
    shaped = verdict_xml(cards)
    rows = shaped.select(F.to_xml(F.struct(*shaped.columns), {"rowTag": "verdict", "indent": ""}).alias("value"))
    flat = F.regexp_replace("value", r"[\r\n]+", " ")
    head = cards.agg(F.count(F.lit(1)).alias("n")).select(
        said('<?xml version="1.0" encoding="UTF-8"?><verdicts count="', F.col("n").cast("string"), '">').alias("value"))
    return write_lines(_framed(head, rows.select(flat.alias("value")), "</verdicts>"), path, "\n", compression)


def _framed(head: DataFrame, body: DataFrame, tail: str) -> DataFrame:
    """Head line, body lines and tail line, each in part files that sort in this order."""
    last = head.sparkSession.range(0, 1, 1, 1).select(F.lit(tail).alias("value"))
    return head.coalesce(1).union(body).union(last)


COLLECTION = ('{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}},'
              '"features":[')


def write_geojson(geometry: DataFrame, points: DataFrame, path: str) -> str:
    """One feature collection in CRS84, a feature per line; part files join in name order to one document.

    The least feature stands in the head line, so that every other one can begin with its comma.
    """
    features = geojson_features(geometry, points)
    rows = with_row(features, features.agg(F.min("value").alias("first")))
    least = rows.agg(F.min("first").alias("first"), F.count_if(F.col("value") == F.col("first")).alias("n"))
    head = least.select(F.concat(F.lit(COLLECTION), F.coalesce("first", F.lit(""))).alias("value"))
    again = least.filter("n > 1").select(F.explode(F.array_repeat(F.concat(F.lit(","), "first"), (F.col("n") - 1).cast("int")))
                                         .alias("value"))
    body = rows.filter(F.col("value") != F.col("first")).select(F.concat(F.lit(","), "value").alias("value"))
    return write_lines(_framed(head, again.union(body), "]}"), path, "\n")


def geojson_features(geometry: DataFrame, points: DataFrame) -> DataFrame:
    """One feature per line, longitude first, CRS84: a line per object, a point per verdict."""
    line = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"),
                 F.array(F.array("lon1", "lat1"), F.array("lon2", "lat2")).alias("coordinates")).alias("geometry"),
        F.struct(F.lit("collector").alias("kind"), "object_name", F.col("toponym").alias("district"),
                 F.col("anchor_known").alias("anchored"), "picket_min", "picket_max", "length_m",
                 F.col("n_cards").alias("verdicts"), "max_probability").alias("properties")),
        {"ignoreNullFields": "false"})
    point = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct(F.lit("verdict").alias("kind"), "object_name", "picket", "scenario", "probability", "title")
        .alias("properties")), {"ignoreNullFields": "false"})
    return geometry.select(line.alias("value")).union(points.select(point.alias("value")))


def _degrees(c: str) -> Column:
    return F.format_string("%.6f", F.col(c))


def wkt_rows(geometry: DataFrame, points: DataFrame) -> DataFrame:
    line = said("LINESTRING(", _degrees("lon1"), " ", _degrees("lat1"), ", ", _degrees("lon2"), " ", _degrees("lat2"), ")")
    spot = said("POINT(", _degrees("lon"), " ", _degrees("lat"), ")")
    none = F.lit("")
    p4 = F.format_string("%.4f", F.bround("probability", 4))
    lines = geometry.select(line.alias("wkt"), F.lit("collector").alias("kind"), "object_name", none.alias("picket"),
                            none.alias("scenario"), F.format_string("%.4f", F.bround("max_probability", 4)).alias("probability"))
    return lines.unionByName(points.select(spot.alias("wkt"), F.lit("verdict").alias("kind"), "object_name",
                                           F.col("picket").cast("string").alias("picket"), "scenario", p4.alias("probability")))


def wkt_csv(geometry: DataFrame, points: DataFrame) -> DataFrame:
    rows = wkt_rows(geometry, points)
    return _lines(rows, rows.columns)


def write_json(cards: DataFrame, path: str, compression: str = "none") -> str:
    cards.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", compression).json(path)
    return path
