"""Journal, dictionary, contract and mart readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tritmarts import fixed_values as fv

# fixed values: source column titles and their names here
JOURNAL_COLUMNS = {
    "ид_события": "event_id", "ид_канала_данных": "channel_id", "дата": "d", "время": "t",
    "тревожное": "is_alarm", "значение_датчика": "raw_value",
}
CHANNEL_COLUMNS = {
    "ид_канала_данных": "channel_id", "тип_инж_системы": "system", "тип_датчика": "sensor_type",
    "название_датчика": "sensor_name", "тег_инженерной_системы": "tag", "ид_объект": "object_id",
}
OBJECT_COLUMNS = {
    "ид_объект": "object_id", "диспетчерское_название_объекта": "object_name", "вид_объекта": "object_kind",
    "родитель": "parent_id",
}
CONTRACT_COLUMNS = {"тип_датчика": "sensor_type", "значение": "raw_value", "семантический_класс": "cls"}
_IDS = {"event_id", "channel_id", "object_id", "parent_id"}


def _csv(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    """All columns as text; columns are then picked by title, wherever they stand."""
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", multiline).option("encoding", "UTF-8").csv(path))


def _named(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[(F.col(f"`{src}`").try_cast("bigint") if name in _IDS else F.col(f"`{src}`")).alias(name)
                       for src, name in columns.items()])


def read_journal_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Yearly journal exports with typed columns; the value is kept as text and as a number."""
    raw = _named(_csv(spark, path), JOURNAL_COLUMNS)
    part = F.split("t", ":")
    seconds = (part[0].cast("int") * 3600 + part[1].cast("int") * 60 + F.floor(part[2].cast("double")).cast("int"))
    value = F.col("raw_value")
    return raw.select(
        "event_id", "channel_id", F.col("d").cast("date").alias("d"), seconds.alias("t_sec"),
        F.lower("is_alarm").isin("true", "t", "1", "да").alias("is_alarm"), "raw_value",
        F.when(value.rlike(fv.NUMBER_PATTERN), value.try_cast("double")).alias("num_value"))


def import_journal(spark: SparkSession, sources: str | list[str], target: str) -> DataFrame:
    """Yearly CSV to Parquet partitioned by year; returns (year, rows) of the years that were imported.

    The years in ``sources`` replace what ``target`` had of them; its other years stay as they are.
    """
    rows = read_journal_csv(spark, sources).withColumn("year", F.year("d"))
    years = [r.year for r in rows.select("year").distinct().collect()]  # one row a year
    write_years(rows, target)
    return read_journal(spark, target).filter(F.col("year").isin(years)).groupBy("year").agg(F.count(F.lit(1)).alias("rows"))


def write_years(df: DataFrame, path: str) -> str:
    """Write ``df``, which has a ``year``, over the partitions of its years only."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year")
     .option("compression", "zstd").parquet(path))
    return path


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_channels(spark: SparkSession, path: str, expected_rows: int | None = None) -> DataFrame:
    """Channel dictionary; names may hold line breaks, so the row count can be demanded."""
    df = _named(_csv(spark, path, multiline=True), CHANNEL_COLUMNS)
    if expected_rows is not None:
        found = df.count()
        if found != expected_rows:
            raise ValueError(f"channel dictionary has {found} rows, expected {expected_rows}: "
                             "check quoting and line breaks inside fields")
    return df


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    return _named(_csv(spark, path, multiline=True), OBJECT_COLUMNS)


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    """Contract pairs without the rows that only describe a pattern."""
    df = _named(_csv(spark, path, multiline=True), CONTRACT_COLUMNS)
    return df.filter(~F.col("raw_value").isin(fv.CONTRACT_PLACEHOLDERS)).dropDuplicates(["sensor_type", "raw_value"])


def write_mart(df: DataFrame, path: str, by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def read_mart(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
