"""Journal-shaped views of the sample tables.

The sample tables are a small trading schema.  Here they are read as a sensor
network: customers and suppliers are channels, regions and nations are objects,
events and line items are journal rows, orders are verdicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tritmarts import fixed_values as fv
from tritmarts.operators.fire import smoke_events
from tritmarts.operators.marts import channel_dimension, fact_channel_day, with_twins
from tritmarts.plans.store import stored
from tritmarts.sources.literal import inline_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# role of a channel by the last digit of its id
ROLES = [fv.SMOKE, fv.SMOKE, fv.HEAT, fv.TEMPERATURE, fv.PUMP, fv.PUMP,
         fv.MOTION, fv.DOOR, fv.HATCH, fv.GUARD]
PLACE_NAMES = ["Зюзино", "Ясенево", "Беляево", "Коньково", "Никулино"]

# raw text by (event type, last digits); "#" keeps the reading itself
VALUES = {
    "view": [([0, 1], "Дыма нет"), ([3], "#"), ([4, 5], fv.OFF), ([6], "Движения нет"),
             ([9], fv.ARMED), (None, "Норма")],
    "click": [([0, 1], fv.SMOKE_ON), ([3], "#,"), ([4, 5], fv.ON), ([6], "Обнаружено движение"),
              ([9], fv.DISARMED), (None, "Не замкнут")],
    "purchase": [([3], "-127"), ([4, 5], fv.ON), ([9], fv.ARMED), (None, "Неопределен")],
    "signup": [([3], "#"), ([4, 5], fv.OFF), ([9], fv.DISARMED), (None, "Отключено устройство")],
    "error": [([9], "01.01.1970 03:00:00"), (None, "Неисправен")],
}


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-precise change events of the customer channels."""
    e = table(spark, sf_dir, "events")
    digit = F.pmod("user_id", F.lit(10))
    plain = F.col("value").cast("string")
    raw = None
    for event, rules in VALUES.items():
        for digits, text in rules:
            hit = F.col("event_type") == event
            if digits is not None:
                hit = hit & digit.isin(digits)
            value = plain if text == "#" else F.replace(plain, F.lit("."), F.lit(",")) if text == "#," else F.lit(text)
            raw = (F if raw is None else raw).when(hit, value)
    rows = e.select(
        "event_id", F.col("user_id").alias("channel_id"), F.to_date("ts").alias("d"),
        (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("t_sec"),
        (F.col("event_type") == "error").alias("is_alarm"), raw.alias("raw_value"))
    return rows.withColumn("num_value", F.col("raw_value").try_cast("double"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("bigint").alias("object_id"),
        F.concat(F.lit("объект "), "r_name").alias("object_name"),
        F.lit("коллектор").alias("object_kind"), F.lit(None).cast("bigint").alias("parent_id"))
    nation = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 10).cast("bigint").alias("object_id"),
        F.concat(F.lit("ПС объект "), "n_name").alias("object_name"),
        F.lit("участок").alias("object_kind"), F.col("n_regionkey").cast("bigint").alias("parent_id"))
    return region.unionByName(nation)


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary rows of the customer channels."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    digit = (key % 10).cast("int")
    role = F.element_at(F.array(*map(F.lit, ROLES)), digit + 1)
    picket = F.floor(key / 10) % 8 * 5 + 1
    place = F.element_at(F.array(*map(F.lit, PLACE_NAMES)), (F.floor(key / 10) % 5).cast("int") + 1)
    name = F.concat(F.when(key % 29 == 0, F.lit("Зона ")).otherwise(F.lit("Н")), (digit + 0).cast("string"),
                    F.lit(" "), place,
                    F.when(key % 37 == 0, F.lit("")).otherwise(F.concat(F.lit(" ПК"), picket.cast("string"))))
    return c.select(
        key.alias("channel_id"),
        F.when(digit <= 2, F.lit("Пожарная сигнализация")).otherwise(F.lit("Диспетчеризация")).alias("system"),
        role.alias("sensor_type"), name.alias("sensor_name"),
        F.concat(F.lit("B"), (key % 7).cast("string"), F.lit("-"), key.cast("string")).alias("tag"),
        F.when(key % 3 == 0, F.col("c_nationkey") + 10).otherwise(F.col("c_nationkey") % 5)
        .cast("bigint").alias("object_id"))


def contract(spark: SparkSession) -> DataFrame:
    """Contract pairs of the customer roles, one pair left out on purpose."""
    both = {"Неисправен": fv.FAULT, "Неопределен": fv.UNDEFINED, "Отключено устройство": fv.DISABLED}
    by_type = {
        fv.SMOKE: {**both, "Дыма нет": fv.NORM, fv.SMOKE_ON: fv.TRIGGER},
        fv.HEAT: {**both, "Норма": fv.NORM, fv.HEAT_TRIP: fv.TRIGGER},
        fv.TEMPERATURE: {"Неисправен": fv.FAULT},
        fv.GAS: {"Неисправен": fv.FAULT, "Неопределен": fv.UNDEFINED, "Норма": fv.NORM},
        fv.PUMP: {fv.ON: fv.TRIGGER, fv.OFF: fv.NORM, "Неисправен": fv.FAULT},
        fv.MOTION: {**both, "Движения нет": fv.NORM, "Обнаружено движение": fv.TRIGGER},
        fv.DOOR: {**both, "Норма": fv.NORM, "Не замкнут": fv.TRIGGER},
        fv.HATCH: {"Неисправен": fv.FAULT, "Неопределен": fv.UNDEFINED, "Норма": fv.NORM,
                   "Не замкнут": fv.TRIGGER},
        fv.GUARD: {fv.ARMED: fv.NORM, fv.DISARMED: fv.DISABLED},
    }
    rows = [(kind, raw, cls) for kind, pairs in by_type.items() for raw, cls in pairs.items()]
    return inline_table(spark, rows, ["sensor_type", "raw_value", "cls"])


def dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel dimension with twins."""
    return stored(spark, sf_dir, "dim", lambda: with_twins(
        channel_dimension(channels(spark, sf_dir), objects(spark, sf_dir))))


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "fact", lambda: fact_channel_day(
        journal(spark, sf_dir), channels(spark, sf_dir), contract(spark)))


# ---- long history: line items of the supplier channels ----------------------

def journal_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven years of day-dated rows; even channels report readings."""
    li = table(spark, sf_dir, "lineitem")
    flag, even = F.col("l_returnflag"), F.col("l_suppkey") % 2 == 0
    raw = (F.when(flag == "R", F.lit("Неисправен"))
           .when(even, F.col("l_quantity").cast("string"))
           .when(flag == "A", F.lit("Норма")).otherwise(F.lit("Неопределен")))
    return li.select(
        F.col("l_suppkey").alias("channel_id"), F.to_date("l_shipdate").alias("d"),
        (F.col("l_orderkey") % 86400).cast("int").alias("t_sec"),
        (flag == "R").alias("is_alarm"), raw.alias("raw_value"))


def channels_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    role = (F.when(key % 10 == 5, F.lit(fv.UPS)).when(key % 2 == 0, F.lit(fv.TEMPERATURE))
            .otherwise(F.lit(fv.GAS)))
    name = F.concat(F.when(key % 23 == 7, F.lit("Зона ")).otherwise(F.lit("Т")),
                    (F.floor(key / 40)).cast("string"), F.lit(" "),
                    F.element_at(F.array(*map(F.lit, PLACE_NAMES)), (key % 5).cast("int") + 1),
                    F.lit(" ПК"), (key % 20).cast("string"))
    return s.select(
        key.alias("channel_id"),
        F.when(key % 3 == 0, F.lit("Пожарная сигнализация")).otherwise(F.lit("Климат")).alias("system"),
        role.alias("sensor_type"), name.alias("sensor_name"),
        F.concat(F.lit("S"), (key % 7).cast("string"), F.lit("-"), key.cast("string")).alias("tag"),
        (F.col("s_nationkey") % 5).cast("bigint").alias("object_id"))


def smoke_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoke events of the long history: a detector next to every supplier channel, fired by some line items."""
    near = channels_long(spark, sf_dir)
    detectors = near.select(
        (F.col("channel_id") + 1_000_000).alias("channel_id"), F.lit("Пожарная сигнализация").alias("system"),
        F.lit(fv.SMOKE).alias("sensor_type"), "sensor_name", "tag", "object_id")
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber = 7 AND l_returnflag = 'A'")
    fired = li.select((F.col("l_suppkey") + 1_000_000).alias("channel_id"), F.to_date("l_shipdate").alias("d"),
                      (F.col("l_orderkey") % 86400).cast("int").alias("t_sec"), F.lit(fv.SMOKE_ON).alias("raw_value"))
    return stored(spark, sf_dir, "smoke_long", lambda: smoke_events(
        fired, channel_dimension(detectors, objects(spark, sf_dir))))


def dim_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "dim_long", lambda: with_twins(
        channel_dimension(channels_long(spark, sf_dir), objects(spark, sf_dir))))


def fact_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "fact_long", lambda: fact_channel_day(
        journal_long(spark, sf_dir), channels_long(spark, sf_dir), contract(spark)))
