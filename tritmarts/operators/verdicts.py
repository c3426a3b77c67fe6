"""Verdict rows of the four scenarios, one wide row per verdict.

Every scenario works on all days of its input at once.  A daily limit is a
top-k per day, which Spark trims before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions import text
from tritmarts.functions.ordering import with_nearest
from tritmarts.functions.numbers import clock, moment
from tritmarts.operators import fire, intrusion, pumps, thermal
from tritmarts.operators.marts import failures
from tritmarts.settings import Cards, Guarding, Thermal

MESSAGE_FORMS = ("сообщение", "сообщения", "сообщений")
TIMES_FORMS = ("раз", "раза", "раз")


def said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def sign(feature: Column | str, group: Column | str, value: Column, contribution: Column, phrase: Column,
         since: Column | None = None) -> Column:
    """One piece of evidence."""
    def col(x):
        return F.lit(x) if isinstance(x, str) else x
    since = F.lit(None).cast("string") if since is None else since
    return F.struct(col(feature).alias("feature"), col(group).alias("group"), value.cast("double").alias("value"),
                    contribution.cast("double").alias("contribution"), since.alias("since"), phrase.alias("phrase"))


def top_per_day(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("d").orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def location(parent: Column, own: Column, picket: Column, channel: Column) -> Column:
    """Parent or object name, then picket; the channel number if neither is known."""
    name = F.coalesce(F.nullif(parent, F.lit("")), F.nullif(own, F.lit("")))
    spot = said("ПК", picket.cast("string"))
    return F.when(name.isNull() & picket.isNull(), said("канал ", channel.cast("string"))) \
        .otherwise(F.concat_ws(", ", name, spot))


def recommendation(scenario: Column, sensor_type: Column) -> Column:
    exact = {f"{s}|{t}": r for s, t, r in fv.RECOMMENDATIONS if t}
    general = {s: r for s, t, r in fv.RECOMMENDATIONS if t is None}
    return F.coalesce(text.lookup(F.concat_ws("|", scenario, sensor_type), exact), text.lookup(scenario, general),
                      F.lit(fv.DEFAULT_RECOMMENDATION))


# ---- failure -----------------------------------------------------------------

def score_days(scored: DataFrame, dim: DataFrame, domains: DataFrame, limit: int = Cards.failure_limit) -> DataFrame:
    """The riskiest channels of each day with their passport and point."""
    return with_passport(top_per_day(scored, [F.col("score").desc(), F.col("channel_id")], limit), dim, domains)


def with_passport(rows: DataFrame, dim: DataFrame, domains: DataFrame) -> DataFrame:
    """Channel-day rows with the passport of the channel and the size of its point."""
    passport = dim.select("channel_id", "sensor_name", "sensor_type", "system", "picket", "object_id",
                          "object_name", "parent_name")
    point = domains.select("object_id", "picket", F.col("n_channels").alias("dom_size"),
                           F.col("has_thermal").alias("dom_thermal"))
    return (rows.join(passport, "channel_id").join(point, ["object_id", "picket"], "left")
            .withColumn("dom_size", F.coalesce("dom_size", F.lit(1)))
            .withColumn("dom_thermal", F.coalesce("dom_thermal", F.lit(False))))


def failure_negatives(smoke_seen: Column) -> Column:
    """What the verdict is not; no fire only where no smoke was recorded."""
    fire_system = F.coalesce("system", F.lit("")).contains("Пожарная")
    calm = F.coalesce("domain_dev_share_7d", F.lit(0.0)) < 0.2
    return text.present(
        F.when(fire_system & ~smoke_seen, F.lit("пожар: сработок дыма за сутки не зафиксировано")),
        F.when(calm, F.lit("массовая авария: соседние каналы точки в норме")))


def failure_blind_spots() -> Column:
    silent = F.col("domain_silent_share")
    fire_system = F.coalesce("system", F.lit("")).contains("Пожарная")
    return text.present(
        F.when(F.col("dom_size") <= 1, F.lit("в этой точке только один канал — подтвердить показания нечем"))
        .when(silent >= 0.5, said("молчит ", text.percent(silent), " соседних каналов точки — картина неполная")),
        F.when(fire_system & ~F.col("dom_thermal"),
               F.lit("тепловых датчиков в этой точке нет, подтвердить температурой нельзя")))


def temperature_evidence(points: DataFrame, state: DataFrame, cfg: Thermal = Thermal()) -> DataFrame:
    """Evidence and blind spots of points (object_id, picket, d) from the nearest thermometer.

    Points and thermometers of an object and day stand in one order of pickets, and the nearer
    of the two neighbours is kept.
    """
    key = ["object_id", "picket", "d"]
    asked = points.select(*key).filter("object_id IS NOT NULL AND picket IS NOT NULL").distinct()
    seen = state.withColumn("phrases", thermal.thermal_phrases(cfg)).withColumn("own_blind", thermal.thermal_blind_spots())
    nearest = with_nearest(asked, seen, ["object_id", "d"], "picket", ["t_avg", "phrases", "own_blind"], cfg.search_pickets, "m")
    any_here = state.select("object_id").distinct().withColumn("_any", F.lit(True))
    m = F.col("m")
    where = F.when(m["dist"] == 0, F.lit("")).otherwise(said(" (датчик в ", (m["dist"] * 10).cast("string"), " м)"))
    found = F.transform(m["phrases"], lambda p: sign("temperature", "тепловой режим", m["t_avg"], F.lit(0.0),
                                                     F.concat(p, where), F.col("d").cast("string")))
    none = F.array().cast("array<string>")
    empty = F.array().cast("array<struct<feature:string,group:string,value:double,contribution:double,"
                           "since:string,phrase:string>>")
    speaks = F.size(m["phrases"]) > 0
    blind = (F.when(m.isNotNull(), F.when(speaks, m["own_blind"]).otherwise(none))
             .when(F.col("_any"), F.array(F.lit(
                 "ближайший температурный датчик дальше 100 м — тепловой режим этой точки не контролируется")))
             .otherwise(F.array(F.lit("температурных датчиков на объекте нет — тепловой режим не контролируется"))))
    return (nearest.join(any_here, "object_id", "left")
            .select(*key, F.when(speaks, found).otherwise(empty).alias("temp_evidence"),
                    blind.alias("temp_blind")))


def precedents(points: DataFrame, fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Latest earlier failure day of each point (object_id, picket, d).

    Failure days and asked days of a point are merged in one ordered sequence;
    each has at most one row per day.
    """
    place = dim.filter(F.col("picket").isNotNull()).select("channel_id", "object_id", "picket")
    days = (fact.filter(failures() > 0).select("channel_id", "d", failures().alias("f")).join(place, "channel_id")
            .groupBy("object_id", "picket", "d").agg(F.sum("f").alias("n")))
    asked = points.select("object_id", "picket", "d").filter("object_id IS NOT NULL AND picket IS NOT NULL").distinct()
    both = (asked.select("*", F.lit(None).cast("bigint").alias("n"), F.lit(0).alias("kind"))
            .unionByName(days.select("*", F.lit(1).alias("kind"))))
    earlier = (Window.partitionBy("object_id", "picket").orderBy("d", "kind")
               .rowsBetween(Window.unboundedPreceding, -1))
    last = F.last(F.when(F.col("kind") == 1, F.struct("d", "n")), ignorenulls=True).over(earlier)
    found = both.withColumn("p", last).filter("kind = 0 AND p IS NOT NULL")
    words = said("Похожий случай: ", F.date_format("p.d", "dd.MM.yyyy"), ", та же точка, ",
                 text.counted(F.col("p.n"), MESSAGE_FORMS), " о неисправности.")
    return found.select("object_id", "picket", "d", words.alias("precedent"))


def with_smoke(rows: DataFrame, smoke: DataFrame) -> DataFrame:
    """Rows (object_id, d) with ``_smoke``: whether smoke was recorded on the object that day."""
    smoky = smoke.select("object_id", "d").distinct().withColumn("_smoke", F.lit(True))
    return rows.join(smoky, ["object_id", "d"], "left").withColumn("_smoke", F.coalesce("_smoke", F.lit(False)))


def failure_verdicts(head: DataFrame, explained: DataFrame, smoke: DataFrame, state: DataFrame, fact: DataFrame,
                     dim: DataFrame, horizon_hours: int = 24) -> DataFrame:
    """Cards of the scored head: all lookups are joins over the whole set.

    ``explained`` has channel_id, d, bias, evidence and counterfactual.
    """
    rows = with_smoke(head.join(explained.drop("score"), ["channel_id", "d"]), smoke)
    key = ["object_id", "picket", "d"]
    rows = (rows.join(temperature_evidence(rows, state), key, "left").join(precedents(rows, fact, dim), key, "left"))
    own = F.transform("evidence", lambda e: sign(e["feature"], e["group"], e["value"], e["contribution"], e["phrase"]))
    evidence = F.concat(own, F.coalesce("temp_evidence", F.array().cast(
        "array<struct<feature:string,group:string,value:double,contribution:double,since:string,phrase:string>>")))
    blind = F.concat(failure_blind_spots(), F.coalesce("temp_blind", F.array().cast("array<string>")))
    scenario = F.lit(fv.FAILURE)
    return rows.select(
        scenario.alias("scenario"), "d", "object_id", F.coalesce("parent_name", "object_name").alias("object_name"),
        "picket", "channel_id", F.col("score").alias("probability"), F.lit(horizon_hours).alias("horizon_hours"),
        F.lit(fv.MODEL_VERSION[fv.FAILURE]).alias("model_version"), F.lit(fv.CARD_TYPE[fv.FAILURE]).alias("card_type"),
        location(F.col("parent_name"), F.col("object_name"), F.col("picket"), F.col("channel_id")).alias("location"),
        F.col("bias").alias("baseline"), evidence.alias("evidence"),
        failure_negatives(F.col("_smoke")).alias("negatives"), blind.alias("blind_spots"),
        "counterfactual", recommendation(scenario, F.col("sensor_type")).alias("recommendation"), "precedent",
        "sensor_name", "sensor_type", "system", F.lit(None).cast("string").alias("episode_at"))


# ---- pumping, fire, intrusion -------------------------------------------------

def _verdict(rows: DataFrame, scenario: str, probability: Column, channel: Column, object_name: Column,
             evidence: Column, negatives: Column, blind: Column, sensor_name: str, sensor_type: Column,
             place: Column, episode: Column) -> DataFrame:
    no = F.lit(None).cast("string")
    return rows.select(
        F.lit(scenario).alias("scenario"), "d", "object_id", object_name.alias("object_name"), "picket",
        channel.cast("bigint").alias("channel_id"), probability.alias("probability"), F.lit(24).alias("horizon_hours"),
        F.lit(fv.MODEL_VERSION[scenario]).alias("model_version"), F.lit(fv.CARD_TYPE[scenario]).alias("card_type"),
        place.alias("location"), F.lit(0.0).alias("baseline"), evidence.alias("evidence"),
        negatives.alias("negatives"), blind.alias("blind_spots"), no.alias("counterfactual"),
        recommendation(F.lit(scenario), no).alias("recommendation"), no.alias("precedent"),
        F.col(sensor_name).alias("sensor_name"), sensor_type.alias("sensor_type"), no.alias("system"),
        episode.alias("episode_at"))


def pump_verdicts(anomaly: DataFrame, days: DataFrame, network: DataFrame, dim: DataFrame,
                  limit: int = Cards.pump_limit) -> DataFrame:
    """Hot pumps of each day, strongest deviation first."""
    hot = top_per_day(anomaly.filter(F.col("trit") == fv.DEVIATION),
                      [F.col("robust_z").desc_nulls_last(), F.col("channel_id")], limit)
    rows = (hot.join(days.select("channel_id", "d", "t_first_start", "t_last_start"), ["channel_id", "d"])
            .join(dim.select("channel_id", "sensor_name", "picket", "object_id", "object_name", "parent_name"), "channel_id")
            .join(network.select("d", "n_hot", "is_network_event"), "d"))
    n, med, ratio, duty = (F.col(c) for c in ("n_starts", "med_starts", "ratio_to_norm", "duty_seconds"))
    first, last = moment(F.col("d"), F.col("t_first_start")), moment(F.col("d"), F.col("t_last_start"))
    evidence = text.present(
        sign("pump_starts", "откачка", n, F.lit(0.5), pumps.starts_phrase(n, med, F.col("sensor_name")), first),
        F.when(first != last, sign("pump_window", "откачка", F.lit(0.0), F.lit(0.0), said(
            "откачка шла с ", clock(F.col("t_first_start")), " до ", clock(F.col("t_last_start"))), first)),
        F.when(ratio >= 1.5, sign("ratio", "откачка", ratio, F.lit(0.3), said(
            "это в ", text.counted(ratio, TIMES_FORMS), " выше личной нормы насоса"), first)),
        F.when(duty > 0, sign("duty", "откачка", duty, F.lit(0.2), said(
            "наработка за сутки ", text.whole(duty / 60), " минут"), first)))
    wide = F.col("is_network_event")
    negatives = F.array(F.when(wide, said("локальная течь: аномалия видна сразу на ", F.col("n_hot").cast("string"),
                                          " насосах сети — это общий водоприток"))
                        .otherwise(said("общесетевой водоприток: кроме этого насоса аномальны лишь ",
                                        (F.col("n_hot") - 1).cast("string"))))
    blind = F.array(F.when(wide, F.lit("источник воды может быть выше по трассе: уклон коллектора в данных не задан"))
                    .otherwise(F.lit("датчики затопления в сети не дают сигнала — вода детектируется косвенно, "
                                     "по режиму откачки")))
    probability = F.least(F.lit(0.95), F.lit(0.25) + 0.12 * F.least(F.coalesce(ratio, F.lit(1.0)), F.lit(6.0))
                          + 0.004 * F.least(n - F.coalesce(med, F.lit(0.0)), F.lit(50.0)))
    place = location(F.col("parent_name"), F.col("object_name"), F.col("picket"), F.col("channel_id"))
    return _verdict(rows, fv.FLOODING, probability, F.col("channel_id"), F.coalesce("parent_name", "object_name"),
                    evidence, negatives, blind, "sensor_name", F.lit(fv.PUMP), place, first)


def _episode(group: str) -> tuple[Column, Column]:
    """Start of an episode and the evidence about its length, if it has one."""
    a, b = F.col("first_t"), F.col("last_t")
    start, seconds = moment(F.col("d"), a), b - a
    span = (F.when(seconds < 60, said(seconds.cast("string"), " с"))
            .when(seconds < 3600, said(text.whole(seconds / 60), " мин"))
            .otherwise(said(text.tenth(seconds / 3600), " ч")))
    words = said("эпизод длился ", span, ": с ", clock(a), " до ", clock(b))
    return start, F.when(a != b, sign("episode_span", group, F.lit(0.0), F.lit(0.0), words, start))


def _reasons(feature: str, group: str, value: Column, score: Column, reasons: Column) -> Column:
    return F.transform(reasons, lambda w: sign(feature, group, value, score / F.size(reasons), w))


def _object_names(dim: DataFrame) -> DataFrame:
    return dim.groupBy("object_id").agg(
        F.coalesce(F.min("parent_name"), F.min("object_name")).alias("place_name"))


def fire_verdicts(candidates: DataFrame, dim: DataFrame, limit: int = Cards.fire_limit) -> DataFrame:
    score, reasons = fire.fire_score()
    rows = (candidates.withColumn("score", score).withColumn("reasons", reasons).filter("score > 0")
            .join(_object_names(dim), "object_id"))
    rows = top_per_day(rows, [F.col("score").desc(), F.col("object_id"), F.col("picket")], limit)
    start, span = _episode("задымление")
    evidence = F.concat(_reasons("fire", "задымление", F.col("n_smoke_ch"), F.col("score"), F.col("reasons")),
                        text.present(span))
    negatives = text.present(F.when(~F.col("is_sweep"), F.lit(
        "регламентная проверка: сработала лишь часть датчиков контроллера")))
    place = said(F.col("place_name"), ", ПК", F.col("picket").cast("string"))
    return _verdict(rows, fv.FIRE, F.col("score"), F.lit(None), F.col("place_name"), evidence, negatives,
                    fire.fire_blind_spots(), "sample_name", F.lit(fv.SMOKE), place, start)


def intrusion_verdicts(episodes: DataFrame, calendar: DataFrame, limit: int = Cards.intrusion_limit,
                       cfg: Guarding = Guarding()) -> DataFrame:
    """Episodes above the floor; the calendar then raises, never creates, a risk."""
    raw, reasons = intrusion.intrusion_score(cfg)
    cal = calendar.select("d", "multiplier", "note")
    rows = (episodes.withColumn("raw", raw).withColumn("reasons", reasons).filter(F.col("raw") >= cfg.min_score)
            .join(cal, "d", "left"))
    raised = F.col("note").isNotNull() & (F.col("multiplier") > 1.0)
    rows = (rows.withColumn("score", F.when(raised, F.least(F.lit(1.0), F.col("raw") * F.col("multiplier")))
                            .otherwise(F.col("raw")))
            .withColumn("reasons", F.when(raised, F.array_append("reasons", F.col("note"))).otherwise(F.col("reasons"))))
    rows = top_per_day(rows, [F.col("score").desc(), F.col("object_id"), F.col("picket")], limit)
    start, span = _episode("охрана")
    evidence = F.concat(_reasons("intrusion", "охрана", F.col("n_types"), F.col("score"), F.col("reasons")),
                        text.present(span))
    negatives = text.present(F.when(F.col("armed_trit") == fv.DEVIATION, F.lit(
        "плановые работы: объект в этот момент был под охраной")))
    name = F.coalesce("parent_name", "object_name")
    place = said(name, ", ПК", F.col("picket").cast("string"))
    return _verdict(rows, fv.INTRUSION, F.col("score"), F.lit(None), name, evidence, negatives,
                    intrusion.intrusion_blind_spots(), "sample_name", F.lit("Охранный контур"), place, start)


def render_card() -> Column:
    """Plain-text card of a verdict row."""
    e = F.transform("evidence", lambda x, i: said(
        "  ", (i + 1).cast("string"), ". ", x["phrase"], "\n     вклад ",
        F.format_string("%+.1f%%", F.bround(x["contribution"] * 100, 1))))

    def block(title: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, said("\n", title, F.array_join(items, "\n")))

    not_this = F.transform("negatives", lambda n: said("Это НЕ ", n))
    blind = F.transform("blind_spots", lambda b: said("  • ", b))
    return F.concat_ws(
        "\n",
        said(F.col("location"), " — ", F.col("card_type"), ", ", text.percent(F.col("probability")), " в ближайшие 24 ч"),
        F.lit(""), F.lit("Почему так решено:"), F.when(F.size(e) > 0, F.array_join(e, "\n")),
        block("", not_this), block("Чего мы не видим:\n", blind),
        said("\n", F.col("counterfactual")), said("\nЧто делать: ", F.col("recommendation")), F.col("precedent"))
