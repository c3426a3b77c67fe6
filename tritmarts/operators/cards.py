"""Card enrichment, timelines and object multicards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions import text
from tritmarts.functions.numbers import moment
from tritmarts.functions.ordering import running_totals
from tritmarts.operators.marts import failures
from tritmarts.operators import cascades
from tritmarts.operators.verdicts import said
from tritmarts.settings import Cards

# which onset column tells when a feature began
ONSET_OF = {
    "fault_week": ["fault_ev_7d", "fault_ratio_90d", "dev_days_7d"],
    "fault_month": ["fault_days_30d"],
    "fault_last": ["days_since_fault"],
    "active_last": ["silence_days", "silence_ratio", "unknown_days_7d"],
    "undefined_week": ["undefined_ev_7d", "undefined_share_7d"],
}


def onsets(asked: DataFrame, fact: DataFrame, days: int = Cards.series_days) -> DataFrame:
    """When each kind of sign began, per asked (channel_id, d).

    The look-back is an equi join on (channel, period): a period is as long as
    the look-back, so two of them cover it.
    """
    span = days + 1
    asked = asked.select("channel_id", F.col("d").alias("day")).distinct()
    n = F.unix_date("day")
    spread = asked.withColumn("_p", F.explode(F.array_distinct(F.array(
        F.floor((n - days) / span), F.floor(n / span)))))
    facts = fact.select("channel_id", "d", "n_ev", failures().alias("bad"), "n_undefined", "t_first", "t_last",
                        "t_first_fault", "t_last_fault", "t_first_undefined",
                        F.floor(F.unix_date("d") / span).alias("_p"))
    age = F.datediff("day", "d")
    rows = spread.join(facts, ["channel_id", "_p"]).filter(age.between(0, days))

    # a channel has one row per day, so day and second pack into one ordered number
    base, no_time = 100_000, 99_999

    def stamp(time: str, fallback: str) -> Column:
        return F.unix_date("d").cast("bigint") * base + F.coalesce(time, fallback, F.lit(no_time))

    def first(cond: Column, value: Column) -> Column:
        return F.min(F.when(cond, value))

    def last(cond: Column, value: Column) -> Column:
        return F.max(F.when(cond, value))

    def unpacked(name: str) -> Column:
        v = F.col(name)
        d = F.date_from_unix_date(F.floor(v / base).cast("int"))
        t = F.nullif(F.pmod(v, F.lit(base)), F.lit(no_time))
        return F.coalesce(moment(d, t), d.cast("string")).alias(name)

    bad, week, month = F.col("bad") > 0, age < 7, age < 30
    out = rows.groupBy("channel_id", "day").agg(
        first(bad & week, stamp("t_first_fault", "t_first")).alias("fault_week"),
        first(bad & month, stamp("t_first_fault", "t_first")).alias("fault_month"),
        last(bad, stamp("t_last_fault", "t_last")).alias("fault_last"),
        last(F.lit(True), stamp("t_last", "t_first")).alias("active_last"),
        first((F.col("n_undefined") > 0) & week, stamp("t_first_undefined", "t_first")).alias("undefined_week"),
        first(((F.col("n_ev") > 0) | bad) & week, stamp("t_first", "t_first")).alias("active_week"))
    return out.select("channel_id", F.col("day").alias("d"), *map(unpacked, [*ONSET_OF, "active_week"]))


def sign_since(feature: Column) -> Column:
    """Onset of one feature, over the columns of ``onsets``; context has none."""
    out = F.when(feature.isin(fv.CONTEXT_FEATURES), F.lit(None).cast("string"))
    for column, names in ONSET_OF.items():
        out = out.when(feature.isin(names), F.col(column))
    return out.otherwise(F.col("active_week"))


def title() -> Column:
    """What happened and where, in one line."""
    name = F.trim(F.nullif("object_name", F.lit("")))
    low, word = F.lower(name), "объект "
    at = F.instr(low, " " + word)
    spot = (F.when(low.startswith(word), said("на объекте ", F.substring(name, F.lit(len(word) + 1), F.length(name))))
            .when(at > 0, said("на объекте ", F.expr("substring(trim(object_name), instr(lower(trim(object_name)), ' объект ') + 8)"),
                               " (", F.expr("substring(trim(object_name), 1, instr(lower(trim(object_name)), ' объект ') - 1)"), ")"))
            .otherwise(said("на объекте ", name)))
    where = F.concat_ws(", ", spot, said("ПК", F.col("picket").cast("string")))
    device = F.coalesce(said(" ", F.nullif("sensor_name", F.lit(""))), F.lit(""))
    kind = F.coalesce(text.lookup(F.col("sensor_type"), fv.SENSOR_GENITIVE), F.lit(fv.GENERIC_SENSOR))
    scenario = F.col("scenario")
    head = (F.when(scenario == fv.FAILURE, said("Прогноз отказа ", kind, device))
            .when(scenario == fv.FLOODING, said(fv.SCENARIO_TITLE[fv.FLOODING], device))
            .otherwise(F.coalesce(text.lookup(scenario, fv.SCENARIO_TITLE), scenario)))
    return F.trim(said(head, " ", where))


def timeline(evidence: Column, created: Column | None = None, acked: Column | None = None,
             closed: Column | None = None, action: Column | None = None, reason: Column | None = None) -> Column:
    """Signs and operator actions in time order, as an array of (ts, kind, text)."""
    entry = "array<struct<ts:string,pos:int,kind:string,text:string>>"
    items = [F.filter(F.transform(evidence, lambda e, i: F.struct(
        e["since"].alias("ts"), i.alias("pos"), F.lit(fv.KIND_SIGN).alias("kind"), e["phrase"].alias("text"))),
        lambda x: x["ts"].isNotNull()).cast(entry)]
    words = F.lit("закрыт")
    if action is not None:
        why = F.coalesce(said(" (", F.nullif(reason, F.lit("")), ")"), F.lit("")) if reason is not None else F.lit("")
        words = F.when(action.isNotNull(), said("закрыт: ", action, why)).otherwise(words)
    for pos, (ts, kind, what) in enumerate([(created, fv.KIND_CREATED, F.lit("сформирован вердикт")),
                                            (acked, fv.KIND_ACK, F.lit("взят в работу диспетчером")),
                                            (closed, fv.KIND_DECISION, words)]):
        if ts is not None:
            items.append(text.present(F.when(ts.isNotNull(), F.struct(
                ts.alias("ts"), F.lit(1000 + pos).alias("pos"), F.lit(kind).alias("kind"), what.alias("text"))))
                .cast(entry))
    ordered = F.array_sort(F.concat(*items))
    return F.transform(ordered, lambda x: F.struct(x["ts"].alias("ts"), x["kind"].alias("kind"), x["text"].alias("text")))


def incubation_phrase(days: Column) -> Column:
    held = said("признаки копятся ", text.counted(days, fv.DAY_FORMS))
    return (F.when(days <= 0, F.lit("признаки появились сегодня — развитие внезапное"))
            .when(days == 1, F.lit("признаки копятся сутки"))
            .when(days <= 3, held)
            .when(days > 3, said(held, " — деградация постепенная, вероятно, можно закрыть плановой заявкой")))


def enrich(verdicts: DataFrame, fact: DataFrame) -> DataFrame:
    """Title, onset of every sign, first sign, incubation and timeline.

    Verdicts of a channel date their signs from its series; episode verdicts
    from the episode itself.
    """
    channel_rows = verdicts.filter(F.col("channel_id").isNotNull())
    rows = verdicts.join(onsets(channel_rows, fact), ["channel_id", "d"], "left")
    own = F.coalesce("episode_at", F.col("d").cast("string"))
    dated = F.transform("evidence", lambda e: F.struct(
        e["feature"].alias("feature"), e["group"].alias("group"), e["value"].alias("value"),
        e["contribution"].alias("contribution"),
        F.when(F.col("channel_id").isNotNull(), sign_since(e["feature"]))
        .otherwise(F.coalesce(e["since"], own)).alias("since"), e["phrase"].alias("phrase")))
    rows = rows.withColumn("evidence", dated).drop(*ONSET_OF, "active_week")
    first = F.array_min(F.transform("evidence", lambda e: e["since"]))
    return (rows.withColumn("title", title()).withColumn("first_sign_at", first)
            .withColumn("incubation_days", F.datediff("d", F.to_date(F.substring("first_sign_at", 1, 10))))
            .withColumn("timeline", timeline(F.col("evidence"))))


# ---- multicards ---------------------------------------------------------------

def _object_key() -> Column:
    return F.coalesce(F.nullif("object_name", F.lit("")), F.lit(fv.NO_OBJECT))


def multicards(cards: DataFrame) -> DataFrame:
    """One header row per object: counts, risk, pickets, summary, blind share.

    ``cards`` has scenario, object_name, picket, probability, title, blind_spots,
    first_sign_at.  Everything is a plain aggregate; the cards themselves stay
    rows (``card_pages``).
    """
    rows = cards.withColumn("object_name", _object_key())
    per_scenario = rows.groupBy("object_name", "scenario").agg(
        F.count(F.lit(1)).alias("n"), F.max("probability").alias("p"))
    forms = None
    for scenario, words in fv.SCENARIO_FORMS.items():
        forms = (F if forms is None else forms).when(F.col("scenario") == scenario, text.counted(F.col("n"), words))
    forms = forms.otherwise(said(F.col("n").cast("string"), " ", F.col("scenario")))
    kinds = per_scenario.groupBy("object_name").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("p")).alias("p"), "scenario",
                                             forms.alias("said")))).alias("_k"))
    best = F.struct("probability", F.coalesce("title", F.lit("")).alias("title"))
    head = rows.groupBy("object_name").agg(
        F.count(F.lit(1)).alias("n_cards"), F.max(best).alias("_top"), F.min("first_sign_at").alias("first_sign_at"),
        F.sort_array(F.collect_set("picket")).alias("pickets"),
        F.count_if(F.size("blind_spots") > 0).alias("n_blind"))
    pk = F.col("pickets")
    first, last = said(F.element_at(pk, 1).cast("string")), said(F.element_at(pk, -1).cast("string"))
    where = (F.when(F.size(pk) == 0, F.lit("")).when(F.size(pk) == 1, said(", ПК", first))
             .otherwise(said(", участок ПК", first, "–ПК", last)))
    words = F.array_join(F.transform("_k", lambda k: k["said"]), ", ")
    top = F.col("_top")
    summary = said(F.col("object_name"), where, ": ", words, ". Наибольший риск ", text.percent(top["probability"]),
                   " — ", top["title"], ".")
    limited = F.when((F.col("n_blind") > 0) & (F.col("n_blind") * 2 >= F.col("n_cards")), said(
        "У ", F.col("n_blind").cast("string"), " из ",
        text.counted(F.col("n_cards"), ("вердикта", "вердиктов", "вердиктов")),
        " ограничена наблюдаемость — подтвердить приборами получится не всё"))
    counts = F.map_from_entries(F.transform("_k", lambda k: F.struct(k["scenario"], -k["n"])))
    return (head.join(kinds, "object_name")
            .select("object_name", "n_cards", top["probability"].alias("max_probability"), counts.alias("scenarios"),
                    "pickets", "first_sign_at", summary.alias("summary"), "n_blind", limited.alias("blind_summary")))


def ranked_cards(cards: DataFrame, tie: str = "id") -> DataFrame:
    """Cards with their place inside the object, riskiest first.

    Places are running totals over risk and ``tie``, so an object of any size, and any number
    of cards of one risk, is ranked by many tasks.
    """
    rows = cards.withColumns({"object_name": _object_key(), "place": F.lit(1).cast("bigint")})
    return (running_totals(rows, [F.col("probability").desc(), F.col(tie)], ["place"], key=["object_name"])
            .drop("place").withColumnRenamed("place_cum", "place"))


def card_pages(cards: DataFrame, tie: str = "id", page_size: int = Cards.page_size) -> DataFrame:
    """Nested cards of an object in pages of bounded length; together they are whole."""
    ranked = ranked_cards(cards, tie).withColumn("page", F.floor((F.col("place") - 1) / page_size))
    inner = [c for c in ranked.columns if c not in ("object_name", "page", "place")]
    return (ranked.groupBy("object_name", "page")
            .agg(F.sort_array(F.collect_list(F.struct("place", *inner))).alias("cards")))


def signs(cards: DataFrame) -> DataFrame:
    """Timeline entries of all cards as rows."""
    rows = cards.withColumn("object_name", _object_key())
    keep = ["object_name", "picket", "sensor_name", "probability", "channel_id"]
    return rows.select(*keep, F.posexplode("timeline").alias("pos", "e")).select(*keep, "pos", "e.ts", "e.kind", "e.text")


def with_cascade(cards: DataFrame, cfg: Cards = Cards()) -> DataFrame:
    """Cards with a ``cascade`` flag: whether one of their signs belongs to a cascade of their object.

    ``cards`` has an ``id``; signs meet cascades by object and moment, never by ranges.
    """
    own = cards.select("id", _object_key().alias("object_name"), F.explode("timeline").alias("e")).select(
        "id", "object_name", cascades.moment(F.col("e.ts")).alias("us"))
    hit = own.join(cascades.moments_in_cascades(signs(cards), cfg), ["object_name", "us"], "left_semi").select("id").distinct()
    return (cards.drop("cascade").join(hit.withColumn("cascade", F.lit(True)), "id", "left")
            .withColumn("cascade", F.coalesce("cascade", F.lit(False))))


def merged_timeline(cards: DataFrame) -> DataFrame:
    """Entries with equal day, kind and text become one with its sources.

    Sources are counted and only the first three are named, so an entry shared
    by very many points is never gathered in one place.
    """
    rows = signs(cards)
    label = F.coalesce(said("ПК", F.col("picket").cast("string")), F.col("sensor_name"), F.lit(""))
    rank = F.struct((-F.col("probability")).alias("p"), F.coalesce("channel_id", F.lit(0)).alias("c"), "pos")
    key = ["object_name", "day", "kind", "text"]
    rows = rows.withColumn("day", F.substring("ts", 1, 10)).withColumn("label", label).withColumn("rank", rank)
    per_label = rows.groupBy(*key, "label").agg(F.min("rank").alias("rank"), F.min_by("ts", "rank").alias("ts"))
    whole = per_label.groupBy(*key).agg(F.min_by("ts", "rank").alias("ts"), F.count_if(F.col("label") != "").alias("n"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("rank"))
    shown = (per_label.filter(F.col("label") != "").withColumn("_i", place).filter("_i <= 3").groupBy(*key)
             .agg(F.sort_array(F.collect_list(F.struct("_i", "label"))).alias("s")))
    both = whole.join(shown, key, "left")
    names = F.transform("s", lambda x: x["label"])
    n = F.col("n")
    more = F.when(n > 3, said(" и ещё ", (n - 3).cast("string"))).otherwise(F.lit(""))
    words = (F.when(n > 1, said(F.col("text"), " — на ", n.cast("string"), " точках (",
                                F.array_join(names, ", "), more, ")"))
             .when(n == 1, said(F.col("text"), " — ", F.get(names, F.lit(0))))
             .otherwise(F.col("text")))
    return both.select("object_name", "ts", "kind", words.alias("text"), n.alias("n_sources"))


def multicard_documents(cards: DataFrame, cfg: Cards = Cards()) -> DataFrame:
    """One document per object and part: header, cards, merged timeline and cascades.

    ``part`` runs from 0; every part repeats the header and holds at most one page of
    each list, in order, so a document stays bounded and the parts together are whole.
    """
    header = multicards(cards)
    fields = ["id", "scenario", "d", "picket", "channel_id", "probability", "title", "first_sign_at", "incubation_days"]
    listed = card_pages(cards.select("object_name", *fields), page_size=cfg.page_size).select(
        "object_name", F.col("page").cast("int").alias("part"), "cards")
    marks = _paged(merged_timeline(cards), ["ts", "kind", "text"], cfg.page_size, "timeline")
    found = cascades.detect_cascades(signs(cards), cfg)
    lines = _paged(found, ["at", "n_signs", "span_seconds", "pickets", "text"], cfg.page_size, "cascades")
    key = ["object_name", "part"]
    parts = listed.join(marks, key, "full").join(lines, key, "full")
    return header.join(parts, "object_name")


def _paged(rows: DataFrame, fields: list[str], size: int, name: str) -> DataFrame:
    """Rows of each object gathered in time order into lists of at most ``size``, by part.

    Places are running totals over slices of the order, never over a whole object.
    """
    order = [F.col(f) for f in fields if f != "pickets"]
    placed = running_totals(rows.withColumn("_one", F.lit(1).cast("bigint")), order, ["_one"], key=["object_name"])
    return (placed.withColumn("part", F.floor((F.col("_one_cum") - 1) / size).cast("int")).groupBy("object_name", "part")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("_one_cum", F.struct(*fields).alias("e")))),
                             lambda x: x["e"]).alias(name)))
