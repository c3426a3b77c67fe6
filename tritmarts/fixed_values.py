"""Vocabulary of the sensor network.

FIXED VALUES.  Everything in this file is data: class names, sensor types,
sentence templates and lookup rows that cards, work orders and exports must
carry verbatim.  There is no logic here.
"""

# --- fixed values: semantic classes and their three-valued state -------------
NORM = "НОРМА"
TRIGGER = "СРАБОТКА"
FAULT = "ОТКАЗ"
DISABLED = "ОТКЛЮЧЕНО"
UNDEFINED = "НЕОПРЕДЕЛЕНО"
GARBAGE = "МУСОР"
NUMERIC = "ТЕЛЕМЕТРИЯ_ЧИСЛО"
UNCOVERED = "НЕПОКРЫТО"
LINK_RESTORED = "НОРМА_СВЯЗЬ_ВОССТАНОВЛЕНА"
BACK_TO_NORMAL = "НОРМА_ВОЗВРАТ"

DEVIATION, UNKNOWN, NORMAL = 1, 0, -1

CLASS_TRIT = {
    NORM: NORMAL,
    TRIGGER: DEVIATION,
    FAULT: DEVIATION,
    DISABLED: UNKNOWN,
    UNDEFINED: UNKNOWN,
    GARBAGE: UNKNOWN,
    NUMERIC: UNKNOWN,
}

# --- fixed values: sensor types ----------------------------------------------
SMOKE = "Датчик дыма"
HEAT = "Тепловой датчик"
TEMPERATURE = "Датчик температуры"
GAS = "Газовый датчик"
MOTION = "Датчик движения"
DOOR = "КД Дверь"
HATCH = "КД Люк"
GLASS = "Стекло"
AV_CONTACT = "КД АВ"
HATCH9 = "9-секционный люк"
PUMP = "Состояние насоса"
FAN = "Состояние вентилятора"
PHASE = "Состояние фазы"
UPS = "ИБП"
GUARD = "Состояние охраны"
SWITCH = "Переключатель"
FLOOD = "Датчик затопления"
ORPHAN_TYPE = "(НЕТ В СПРАВОЧНИКЕ)"
ORPHAN_TYPE_SHORT = "(НЕТ)"

POWER_TYPES = [PHASE, PUMP, FAN, UPS, GUARD]
THERMAL_TYPES = [HEAT, TEMPERATURE]
INTRUSION_DOMAIN_TYPES = [MOTION, DOOR, HATCH]
INTRUSION_TYPES = [MOTION, DOOR, HATCH, GLASS, AV_CONTACT, HATCH9]
MECHANISM_TYPES = [SWITCH, FAN, PUMP]
ZONE_MARKERS = ["зона", "[охранная зона]"]
CONTRACT_PLACEHOLDERS = ["<ЧИСЛО>", "<ДАТА-ВРЕМЯ В ЗНАЧЕНИИ>"]

# --- fixed values: raw states ------------------------------------------------
ON, OFF = "Включен", "Выключен"
ARMED, DISARMED = "На охране", "Снято с охраны"
SMOKE_ON = "Обнаружен дым"
HEAT_TRIP = "Не замкнут"
INTRUSION_VALUES = ["Обнаружено движение", "Не замкнут", "Разбито"]
EPOCH_PREFIX = "01.01.1970"
PICKET_PATTERN = "ПК([0-9]+)"
NUMBER_PATTERN = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
DATETIME_PATTERN = r"^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}$"

# --- fixed values: typed contract (value -> class, some only for a type) -----
TYPED_DISABLED = ["Отключено устройство", DISARMED]
TYPED_UNDEFINED = ["Неопределен"]
TYPED_FAULT = ["Неисправен", "Батарея неисправна", "Батарея разряжена",
               "Много неисправных устройств", "Не определено", "Затоплен"]
TYPED_TRIGGER = [SMOKE_ON, "Обнаружен газ", "Обнаружено движение", HEAT_TRIP,
                 "Рычаг сдернут", "Температура ниже 3ºC", "Температура выше 40ºC",
                 "Работают все насосы в АНС", "Вызов", "Разговор", "Питание от батарей"]
TYPED_NORM = ["Норма", "Дыма нет", "Движения нет", "В норме от +3 до +40",
              "Есть питание", "Питание от сети", "Устройства на объекте исправны",
              "Рычаг норма", ARMED]
DE_ENERGISED = "Обесточен"
GAS_SATURATION = [327.68, 10.23, -10.23]
BROKEN_WIRE = -127.0

# --- fixed values: trit sentences --------------------------------------------
CONFIRMED = "подтверждено: %s и %s одновременно показывают отклонение"
UNCONFIRMABLE = ("подтвердить нечем: %s показывает отклонение, но %s недоступен — "
                 "это не значит, что всё в порядке")
NOT_CONFIRMED = "не подтверждено: %s сработал, но %s в норме — вероятно, одиночный шум"
BOTH_NORMAL = "норма: %s и %s в пределах нормы"

# --- fixed values: features (name, group, higher is worse) -------------------
FEATURES = [
    ("ev_7d", "активность", True),
    ("ev_ratio_7d", "активность", True),
    ("active_days_7d", "активность", False),
    ("silence_days", "молчание", True),
    ("silence_ratio", "молчание", True),
    ("fault_ev_7d", "отказы", True),
    ("fault_days_30d", "отказы", True),
    ("fault_ratio_90d", "отказы", True),
    ("days_since_fault", "отказы", False),
    ("undefined_ev_7d", "связь", True),
    ("undefined_share_7d", "связь", True),
    ("dev_days_7d", "состояние", True),
    ("unknown_days_7d", "состояние", True),
    ("domain_size", "окружение", False),
    ("domain_dev_share_7d", "окружение", True),
    ("domain_silent_share", "окружение", True),
    ("base_failed_share_7d", "инфраструктура", True),
    ("channel_age_days", "контекст", False),
    ("month", "контекст", False),
    ("is_weekend", "контекст", False),
]
FEATURE_NAMES = [name for name, _, _ in FEATURES]
CONTEXT_FEATURES = ["month", "is_weekend", "channel_age_days", "domain_size"]
MIN_SUPPORT = {
    "fault_ratio_90d": ("fault_ev_7d", 3.0),
    "ev_ratio_7d": ("ev_7d", 5.0),
    "silence_ratio": ("silence_days", 2.0),
    "undefined_share_7d": ("undefined_ev_7d", 3.0),
}
PRECURSOR_FEATURES = ["fault_ev_7d", "fault_days_30d", "undefined_ev_7d", "ev_7d",
                      "dev_days_7d", "domain_dev_share_7d", "base_failed_share_7d",
                      "silence_days"]
ABLATION_GROUPS = {
    "окружение": ["domain_size", "domain_dev_share_7d", "domain_silent_share"],
    "инфраструктура": ["base_failed_share_7d"],
    "связь": ["undefined_ev_7d", "undefined_share_7d"],
    "молчание": ["silence_days", "silence_ratio", "active_days_7d"],
    "самодиагностика": ["fault_ev_7d", "fault_days_30d", "fault_ratio_90d",
                        "days_since_fault"],
}
MUTED_AS_MISSING = ["fault_ratio_90d", "silence_ratio"]
DAY_FORMS = ("сутки", "суток", "суток")
CHANNEL_FORMS = ("канал", "канала", "каналов")
FEATURE_PHRASES = {
    "ev_7d": "событий за 7 суток: {whole} при обычных {base}",
    "ev_ratio_7d": "темп событий к личной норме канала: ×{tenth}",
    "active_days_7d": "канал выходил на связь {whole} {days} из 7",
    "silence_days": "молчит {whole} {days} подряд",
    "silence_ratio": "молчание превышает обычный для канала интервал в {tenth} раза",
    "fault_ev_7d": "сообщений о неисправности за 7 суток: {whole}",
    "fault_days_30d": "суток с неисправностью за месяц: {whole}",
    "fault_ratio_90d": "неисправностей в {tenth} раза больше личной нормы канала",
    "days_since_fault": "последняя неисправность: {whole} {days} назад",
    "undefined_ev_7d": "потерь связи за 7 суток: {whole}",
    "undefined_share_7d": "доля событий без определённого состояния: {percent}",
    "dev_days_7d": "суток с отклонением за неделю: {whole} из 7",
    "unknown_days_7d": "суток без наблюдаемости за неделю: {whole} из 7",
    "domain_size": "в этой точке {whole} {channels}",
    "domain_dev_share_7d": "соседей по точке в отклонении: {percent}",
    "domain_silent_share": "соседей по точке молчат: {percent}",
    "base_failed_share_7d": "каналов контроллера в отказе: {percent}",
    "channel_age_days": "канал в эксплуатации {whole} {days}",
    "month": "месяц {whole}",
    "is_weekend": "выходной день",
}
FAULT_TODAY = "неисправность зафиксирована сегодня"
LINKED_TODAY = "канал выходил на связь сегодня"
WORKING_DAY = "будний день"

# --- fixed values: scenarios -------------------------------------------------
FAILURE, FLOODING, FIRE, INTRUSION = "отказ", "подтопление", "пожар", "проникновение"
SCENARIO_TITLE = {
    FAILURE: "Прогноз отказа",
    FLOODING: "Аномальный режим откачки",
    FIRE: "Возможное задымление",
    INTRUSION: "Возможное проникновение",
}
SCENARIO_FORMS = {
    FAILURE: ("отказ", "отказа", "отказов"),
    FLOODING: ("подтопление", "подтопления", "подтоплений"),
    FIRE: ("задымление", "задымления", "задымлений"),
    INTRUSION: ("проникновение", "проникновения", "проникновений"),
}
CARD_TYPE = {
    FAILURE: "отказ датчика",
    FLOODING: "аномальный режим откачки",
    FIRE: "возможное задымление",
    INTRUSION: "возможное проникновение",
}
MODEL_VERSION = {
    FAILURE: "m1-failure-v2",
    FLOODING: "m2-pump-v1",
    FIRE: "m3-fire-v1",
    INTRUSION: "m4-intrusion-v1",
}
SENSOR_GENITIVE = {
    "Датчик дыма": "дымового датчика",
    "Тепловой датчик": "теплового датчика",
    "Датчик температуры": "датчика температуры",
    "Газовый датчик": "газового датчика",
    "Датчик движения": "датчика движения",
    "Датчик затопления": "датчика затопления",
    "КД Дверь": "дверного контакта",
    "КД Люк": "контакта люка",
    "КД АВ": "контакта АВ",
    "Стекло": "датчика разбития стекла",
    "Ручной извещатель": "ручного извещателя",
    "Состояние насоса": "канала насоса",
    "Состояние вентилятора": "канала вентилятора",
    "Состояние фазы": "канала контроля фазы",
    "Переключатель": "переключателя",
    "Состояние УИР-Р": "канала УИР-Р",
    "ИБП": "источника бесперебойного питания",
}
GENERIC_SENSOR = "датчика"

# --- fixed values: recommendations (scenario, sensor type or None) -----------
RECOMMENDATIONS = [
    ("отказ", "Датчик дыма", "Проверить шлейф пожарной сигнализации на участке и питание шкафа ОПС."),
    ("отказ", "Датчик температуры", "Проверить линию связи датчика; при повторе — заменить измерительный элемент."),
    ("отказ", "Газовый датчик", "Проверить питание и калибровку газоанализатора."),
    ("отказ", "КД Дверь", "Проверить контактную группу и шлейф двери."),
    ("отказ", "Датчик движения", "Проверить питание извещателя и юстировку."),
    ("отказ", None, "Проверить питание и линию связи канала."),
    ("подтопление", None, "Осмотреть приямок и решётки, проверить работу насоса и уровень притока. "
                          "При общесетевом водопритоке локальный ремонт не даст эффекта."),
    ("пожар", None, "Направить бригаду для визуального осмотра участка. "
                    "При отсутствии термоконтроля полагаться только на осмотр."),
    ("проникновение", None, "Проверить целостность люков и дверей на участке, "
                            "при подтверждении — вызвать группу реагирования."),
]
DEFAULT_RECOMMENDATION = "Проверить состояние оборудования на участке."

# --- fixed values: work types and responsible services -----------------------
WORK_TYPES = [
    ("отказ", "Датчик дыма", "Проверка шлейфа пожарной сигнализации"),
    ("отказ", "Тепловой датчик", "Проверка теплового извещателя"),
    ("отказ", "Датчик температуры", "Проверка температурного датчика и линии связи"),
    ("отказ", "Газовый датчик", "Проверка и калибровка газоанализатора"),
    ("отказ", "Датчик движения", "Проверка объёмного извещателя"),
    ("отказ", "КД Дверь", "Проверка дверного контакта и шлейфа"),
    ("отказ", "КД Люк", "Проверка контакта люка"),
    ("отказ", "КД АВ", "Проверка контакта АВ"),
    ("отказ", None, "Проверка канала и линии связи"),
    ("подтопление", None, "Обследование приямка и насосного оборудования"),
    ("пожар", None, "Визуальный осмотр участка, проверка пожарной сигнализации"),
    ("проникновение", None, "Осмотр люков и дверей участка, проверка охранного контура"),
]
DEFAULT_WORK_TYPE = "Обследование оборудования"
RESPONSIBLE = {
    "отказ": "Служба эксплуатации КИПиА",
    "подтопление": "Служба водоудаления",
    "пожар": "Дежурная бригада",
    "проникновение": "Группа реагирования",
}
DEFAULT_RESPONSIBLE = "Служба эксплуатации"
LOW, MEDIUM, HIGH, EMERGENCY = "низкий", "средний", "высокий", "аварийный"
DUE_DAYS = {EMERGENCY: 1, HIGH: 3, MEDIUM: 10, LOW: 30}
DRAFT_STATUS = "черновик"
STATUS_NEW, STATUS_IN_WORK, STATUS_CLOSED = "новый", "в работе", "закрыт"
NON_ESSENTIAL_REASONS = ["Ложное срабатывание", "Профилактика", "Плановая проверка",
                         "Технологические испытания"]
KIND_SIGN, KIND_CREATED = "признак", "вердикт"
KIND_ACK, KIND_DECISION = "квитирование", "решение"
NO_OBJECT = "без привязки к объекту"
NO_OBJECT_SHORT = "без объекта"

# --- fixed values: calendar (month, day, name) -------------------------------
HOLIDAYS = [
    (1, 1, "Новый год"),
    (1, 2, "Новогодние каникулы"),
    (1, 3, "Новогодние каникулы"),
    (1, 4, "Новогодние каникулы"),
    (1, 5, "Новогодние каникулы"),
    (1, 6, "Новогодние каникулы"),
    (1, 7, "Рождество Христово"),
    (1, 8, "Новогодние каникулы"),
    (2, 23, "День защитника Отечества"),
    (3, 8, "Международный женский день"),
    (5, 1, "Праздник Весны и Труда"),
    (5, 9, "День Победы"),
    (6, 12, "День России"),
    (11, 4, "День народного единства"),
]
SPECIAL_DAY = (5, 9, "День Победы")

# --- fixed values: district anchors (name stem, latitude, longitude) ---------
DISTRICT_ANCHORS = [
    ("Зюзино", 55.6560, 37.5760),
    ("Ясенево", 55.6030, 37.5330),
    ("Беляево", 55.6420, 37.5240),
    ("Коньково", 55.6330, 37.5180),
    ("Коммунарк", 55.5680, 37.4720),
    ("Вавиловск", 55.6790, 37.5620),
    ("Ленинский", 55.6900, 37.5480),
    ("Гарибальди", 55.6680, 37.5570),
    ("Никулино", 55.6620, 37.4770),
    ("Черемушк", 55.6700, 37.5620),
    ("Академическая", 55.6880, 37.5730),
    ("Профсоюзн", 55.6770, 37.5620),
    ("Гагарин", 55.7080, 37.5830),
    ("Донской", 55.7120, 37.6010),
    ("Андреевск", 55.7160, 37.5760),
    ("Зелинско", 55.6840, 37.5450),
    ("Новочер", 55.6780, 37.5760),
    ("союзн", 55.6770, 37.5620),
]
DEFAULT_ANCHOR = (55.66, 37.55)
METERS_PER_DEGREE = 111320.0

# --- fixed values: export columns (key, title) -------------------------------
FLAT_COLUMNS = [
    ("id", "идентификатор"),
    ("created_at", "сформирован"),
    ("scenario", "сценарий"),
    ("object_name", "объект"),
    ("picket", "пикет"),
    ("channel_id", "канал"),
    ("probability", "вероятность"),
    ("horizon_hours", "горизонт_часов"),
    ("status", "статус"),
    ("title", "описание"),
    ("first_sign_at", "первый_признак"),
    ("incubation_days", "вызревание_суток"),
    ("evidence", "улики"),
    ("blind_spots", "слепые_зоны"),
    ("recommendation", "рекомендация"),
]

# --- fixed values: report buckets --------------------------------------------
INCUBATION_BUCKETS = [
    (0, 0, "сегодня"),
    (1, 7, "1–7 суток"),
    (8, 30, "8–30 суток"),
    (31, 60, "31–60 суток"),
    (61, None, "свыше 60 суток"),
]
SYNC_BUCKETS = [
    (0.95, "синхронны (>=95%) — пороги одного прибора"),
    (0.70, "скорее синхронны (70-95%)"),
    (0.40, "слабо связаны (40-70%)"),
    (0.0, "независимы (<40%) — разные приборы"),
]
DOMAIN_BUCKETS = [
    (1, "1 канал — подтверждать нечем"),
    (3, "2-3 канала"),
    (10, "4-10 каналов"),
    (None, "более 10"),
]
CONTROL_TYPES = [
    ("Тепловой датчик", "тепловой контроль"),
    ("Датчик затопления", "контроль затопления"),
    ("Состояние насоса", "контроль насосов"),
    ("Датчик температуры", "температурный контроль"),
    ("Датчик дыма", "контроль задымления"),
]
INCIDENT_TYPES = {
    "задымление": ["Датчик дыма", "Тепловой датчик"],
    "подтопление": ["Состояние насоса", "Датчик затопления"],
    "проникновение": ["КД Люк", "КД Дверь", "Датчик движения"],
}
