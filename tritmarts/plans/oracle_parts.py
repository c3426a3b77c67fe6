"""Shared building blocks of the oracle SQL (DuckDB dialect)."""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}


def part(name: str, body: str) -> None:
    PARTS[name] = body.strip()


def with_parts(select: str) -> str:
    """Prefix a SELECT with every named part it (transitively) reads."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\b[a-z_][a-z0-9_]*\b", text):
            if word in PARTS and word not in order:
                visit_part(word)

    busy: set[str] = set()

    def visit_part(name: str) -> None:
        if name in order or name in busy:
            return
        busy.add(name)
        visit(PARTS[name])
        order.append(name)

    visit(select)
    if not order:
        return select
    head = ",\n".join(f"{name} AS (\n{PARTS[name]}\n)" for name in order)
    return f"WITH {head}\n{select}"


part("q_journal", """
SELECT event_id, user_id AS channel_id, CAST(ts AS DATE) AS d,
       CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS t_sec,
       event_type = 'error' AS is_alarm,
       CASE event_type || (user_id % 10)
         WHEN 'view0' THEN 'Дыма нет' WHEN 'view1' THEN 'Дыма нет'
         WHEN 'view3' THEN CAST(value AS VARCHAR) WHEN 'view4' THEN 'Выключен'
         WHEN 'view5' THEN 'Выключен' WHEN 'view6' THEN 'Движения нет' WHEN 'view9' THEN 'На охране'
         WHEN 'click0' THEN 'Обнаружен дым' WHEN 'click1' THEN 'Обнаружен дым'
         WHEN 'click3' THEN replace(CAST(value AS VARCHAR), '.', ',')
         WHEN 'click4' THEN 'Включен' WHEN 'click5' THEN 'Включен'
         WHEN 'click6' THEN 'Обнаружено движение' WHEN 'click9' THEN 'Снято с охраны'
         WHEN 'purchase3' THEN '-127' WHEN 'purchase4' THEN 'Включен' WHEN 'purchase5' THEN 'Включен'
         WHEN 'purchase9' THEN 'На охране'
         WHEN 'signup3' THEN CAST(value AS VARCHAR) WHEN 'signup4' THEN 'Выключен'
         WHEN 'signup5' THEN 'Выключен' WHEN 'signup9' THEN 'Снято с охраны'
         WHEN 'error9' THEN '01.01.1970 03:00:00'
         ELSE CASE event_type WHEN 'view' THEN 'Норма' WHEN 'click' THEN 'Не замкнут'
              WHEN 'purchase' THEN 'Неопределен' WHEN 'signup' THEN 'Отключено устройство'
              ELSE 'Неисправен' END
       END AS raw_value
FROM events
""")

part("q_objects", """
SELECT CAST(r_regionkey AS BIGINT) AS object_id, 'объект ' || r_name AS object_name,
       'коллектор' AS object_kind, CAST(NULL AS BIGINT) AS parent_id
FROM region
UNION ALL
SELECT n_nationkey + 10, 'ПС объект ' || n_name, 'участок', n_regionkey FROM nation
""")

part("q_roles", """
SELECT unnest([0,1,2,3,4,5,6,7,8,9]) AS digit,
       unnest(['Датчик дыма','Датчик дыма','Тепловой датчик','Датчик температуры',
               'Состояние насоса','Состояние насоса','Датчик движения','КД Дверь',
               'КД Люк','Состояние охраны']) AS sensor_type
""")

part("q_places", """
SELECT unnest([0,1,2,3,4]) AS n,
       unnest(['Зюзино','Ясенево','Беляево','Коньково','Никулино']) AS place
""")

part("q_channels", """
SELECT c_custkey AS channel_id,
       CASE WHEN c_custkey % 10 <= 2 THEN 'Пожарная сигнализация' ELSE 'Диспетчеризация' END AS system,
       sensor_type,
       CASE WHEN c_custkey % 29 = 0 THEN 'Зона ' ELSE 'Н' END || (c_custkey % 10) || ' ' || place
         || CASE WHEN c_custkey % 37 = 0 THEN '' ELSE ' ПК' || (c_custkey // 10 % 8 * 5 + 1) END AS sensor_name,
       'B' || (c_custkey % 7) || '-' || c_custkey AS tag,
       CAST(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 10 ELSE c_nationkey % 5 END AS BIGINT) AS object_id
FROM customer
JOIN q_roles ON digit = c_custkey % 10
JOIN q_places ON n = c_custkey // 10 % 5
""")

part("q_contract", """
SELECT * FROM (VALUES
 ('Датчик дыма','Неисправен','ОТКАЗ'),('Датчик дыма','Неопределен','НЕОПРЕДЕЛЕНО'),
 ('Датчик дыма','Отключено устройство','ОТКЛЮЧЕНО'),('Датчик дыма','Дыма нет','НОРМА'),
 ('Датчик дыма','Обнаружен дым','СРАБОТКА'),
 ('Тепловой датчик','Неисправен','ОТКАЗ'),('Тепловой датчик','Неопределен','НЕОПРЕДЕЛЕНО'),
 ('Тепловой датчик','Отключено устройство','ОТКЛЮЧЕНО'),('Тепловой датчик','Норма','НОРМА'),
 ('Тепловой датчик','Не замкнут','СРАБОТКА'),
 ('Датчик температуры','Неисправен','ОТКАЗ'),
 ('Газовый датчик','Неисправен','ОТКАЗ'),('Газовый датчик','Неопределен','НЕОПРЕДЕЛЕНО'),
 ('Газовый датчик','Норма','НОРМА'),
 ('Состояние насоса','Включен','СРАБОТКА'),('Состояние насоса','Выключен','НОРМА'),
 ('Состояние насоса','Неисправен','ОТКАЗ'),
 ('Датчик движения','Неисправен','ОТКАЗ'),('Датчик движения','Неопределен','НЕОПРЕДЕЛЕНО'),
 ('Датчик движения','Отключено устройство','ОТКЛЮЧЕНО'),('Датчик движения','Движения нет','НОРМА'),
 ('Датчик движения','Обнаружено движение','СРАБОТКА'),
 ('КД Дверь','Неисправен','ОТКАЗ'),('КД Дверь','Неопределен','НЕОПРЕДЕЛЕНО'),
 ('КД Дверь','Отключено устройство','ОТКЛЮЧЕНО'),('КД Дверь','Норма','НОРМА'),
 ('КД Дверь','Не замкнут','СРАБОТКА'),
 ('КД Люк','Неисправен','ОТКАЗ'),('КД Люк','Неопределен','НЕОПРЕДЕЛЕНО'),
 ('КД Люк','Норма','НОРМА'),('КД Люк','Не замкнут','СРАБОТКА'),
 ('Состояние охраны','На охране','НОРМА'),('Состояние охраны','Снято с охраны','ОТКЛЮЧЕНО')
) AS pairs(kind, txt, meaning)
""")


def dimension(channels: str) -> str:
    return f"""
SELECT ch.channel_id, ch.system, ch.sensor_type, ch.sensor_name, ch.tag, ch.object_id,
       string_split(ch.tag, '-')[1] AS tag_base,
       CAST(nullif(regexp_extract(ch.sensor_name, 'ПК(\\d+)', 1), '') AS BIGINT) AS picket,
       own.object_name, own.object_kind, own.parent_id, up.object_name AS parent_name,
       lower(ch.sensor_name) LIKE '%зона%' AS is_zone_aggregate,
       ch.sensor_type IN ('Состояние фазы','Состояние насоса','Состояние вентилятора','ИБП',
                          'Состояние охраны') AS is_power_type,
       count(*) OVER same AS twin_count,
       dense_rank() OVER (ORDER BY ch.object_id, ch.sensor_name, ch.sensor_type) AS twin_group
FROM {channels} ch
LEFT JOIN q_objects own ON own.object_id = ch.object_id
LEFT JOIN q_objects up ON up.object_id = own.parent_id
WINDOW same AS (PARTITION BY ch.object_id, ch.sensor_name, ch.sensor_type)
"""


def classified(journal: str, dim: str) -> str:
    return f"""
SELECT named.*, CASE meaning_ WHEN 'НОРМА' THEN -1 WHEN 'СРАБОТКА' THEN 1 WHEN 'ОТКАЗ' THEN 1 ELSE 0 END AS trit
FROM (
  SELECT parsed.*, coalesce(meaning, CASE WHEN num_ok IS NULL THEN 'МУСОР' ELSE 'ТЕЛЕМЕТРИЯ_ЧИСЛО' END) AS meaning_
  FROM (
    SELECT j.*, dm.sensor_type,
           CASE WHEN x BETWEEN -40 AND 150 AND x NOT IN (-127, -3276, 999) THEN x END AS num_ok
    FROM (SELECT *, TRY_CAST(replace(raw_value, ',', '.') AS DOUBLE) AS x FROM {journal}) j
    LEFT JOIN {dim} dm USING (channel_id)
  ) parsed
  LEFT JOIN q_contract ON kind = sensor_type AND txt = raw_value
) named
"""


def channel_days(classed: str) -> str:
    def n(*names: str) -> str:
        return "sum(CASE WHEN meaning_ IN (%s) THEN 1 ELSE 0 END)" % ", ".join(f"'{x}'" for x in names)

    def t(fn: str, *names: str) -> str:
        return "%s(CASE WHEN meaning_ IN (%s) THEN t_sec END)" % (fn, ", ".join(f"'{x}'" for x in names))

    return f"""
SELECT channel_id, d, count(*) AS n_ev, CAST(sum(is_alarm::INT) AS BIGINT) AS n_alarm,
       CAST(max(trit) AS BIGINT) AS trit_day,
       CAST({n('НОРМА')} AS BIGINT) AS n_norm, CAST({n('СРАБОТКА')} AS BIGINT) AS n_trigger,
       CAST({n('ОТКАЗ')} AS BIGINT) AS n_fault, CAST({n('ОТКЛЮЧЕНО')} AS BIGINT) AS n_disabled,
       CAST({n('НЕОПРЕДЕЛЕНО')} AS BIGINT) AS n_undefined, CAST({n('МУСОР')} AS BIGINT) AS n_garbage,
       CAST({n('ТЕЛЕМЕТРИЯ_ЧИСЛО')} AS BIGINT) AS n_numeric,
       avg(num_ok) AS num_avg, min(num_ok) AS num_min, max(num_ok) AS num_max, count(num_ok) AS n_num_ok,
       min(t_sec) AS t_first, max(t_sec) AS t_last,
       {t('min', 'ОТКАЗ', 'ОТКЛЮЧЕНО')} AS t_first_fault, {t('max', 'ОТКАЗ', 'ОТКЛЮЧЕНО')} AS t_last_fault,
       {t('min', 'СРАБОТКА')} AS t_first_trigger, {t('min', 'НЕОПРЕДЕЛЕНО')} AS t_first_undefined
FROM {classed} GROUP BY channel_id, d
"""


part("q_dim", dimension("q_channels"))
part("q_classed", classified("q_journal", "q_channels"))
part("q_fact", channel_days("q_classed"))

part("q_journal_long", """
SELECT l_suppkey AS channel_id, CAST(l_shipdate AS DATE) AS d, l_orderkey % 86400 AS t_sec,
       l_returnflag = 'R' AS is_alarm,
       CASE WHEN l_returnflag = 'R' THEN 'Неисправен'
            WHEN l_suppkey % 2 = 0 THEN CAST(l_quantity AS VARCHAR)
            WHEN l_returnflag = 'A' THEN 'Норма' ELSE 'Неопределен' END AS raw_value
FROM lineitem
""")
part("q_channels_long", """
SELECT s_suppkey AS channel_id,
       CASE WHEN s_suppkey % 3 = 0 THEN 'Пожарная сигнализация' ELSE 'Климат' END AS system,
       CASE WHEN s_suppkey % 10 = 5 THEN 'ИБП' WHEN s_suppkey % 2 = 0 THEN 'Датчик температуры'
            ELSE 'Газовый датчик' END AS sensor_type,
       CASE WHEN s_suppkey % 23 = 7 THEN 'Зона ' ELSE 'Т' END || (s_suppkey // 40) || ' ' || place
         || ' ПК' || (s_suppkey % 20) AS sensor_name,
       'S' || (s_suppkey % 7) || '-' || s_suppkey AS tag,
       CAST(s_nationkey % 5 AS BIGINT) AS object_id
FROM supplier JOIN q_places ON n = s_suppkey % 5
""")
part("q_dim_long", dimension("q_channels_long"))
part("q_classed_long", classified("q_journal_long", "q_channels_long"))
part("q_fact_long", channel_days("q_classed_long"))
