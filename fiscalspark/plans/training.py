"""Question/answer records for teaching a model to turn questions into requests.

Subjects (objects, organizations, codes …) come from the fact table; every subject is expanded by the
templates of its kind. Templates are small constant arrays, so the expansion is an ``explode`` beside
each subject row: no cross join and no shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from fiscalspark.operators.distinct import catalogue
from fiscalspark.sources.mart import dealt

# --- Fixed values: vocabulary of the questions -------------------------------------------------
FILTER_KEYS = (
    "source_groups", "object_query", "budget_query", "organization_query", "document_id", "document_number",
    "kfsr_code", "kcsr_code", "kvr_code", "kvsr_code", "kesr_code", "kosgu_code", "purpose_code", "funding_source",
)
METRIC_PHRASES = {
    "limits": ("лимиты", "объем лимитов", "лимиты финансирования"),
    "obligations": ("обязательства", "подтвержденные лимиты по БО"),
    "obligations_without_bo": ("обязательства без бо", "лимиты без БО"),
    "remaining_limits": ("остаток лимитов", "остаточные лимиты"),
    "cash_payments": ("кассовые выплаты", "кассовое исполнение"),
    "agreement_amount": ("сумму соглашений", "объем соглашений"),
    "contract_amount": ("сумму контрактов", "объем контрактов"),
    "contract_payment": ("платежи по контрактам", "оплату по контрактам"),
    "institution_payments_with_refund": ("выплаты буау с учетом возврата",),
    "institution_payments_execution": ("исполнение буау", "выплаты буау исполнение"),
    "institution_payments_recovery": ("восстановление выплат буау",),
}
SUBJECT_METRICS = tuple(m for m in METRIC_PHRASES if not m.startswith("institution_payments_"))
OBJECT_VERBS = ("Покажи", "Выведи", "Нужны", "Построй")
ORGANIZATION_VERBS = ("Покажи", "Выведи")
GROUPINGS = ((None, ""), ("month", " по месяцам"), ("year", " по годам"))
SOURCE_PHRASES = {
    "rchb": ("по источнику rchb", "из рчб"),
    "agreements": ("по источнику agreements", "из соглашений"),
    "gz": ("по источнику gz", "из gz"),
    "buau": ("по источнику buau", "из буау"),
}
SOURCE_METRICS = {
    "rchb": ("limits", "obligations", "obligations_without_bo", "remaining_limits", "cash_payments"),
    "agreements": ("agreement_amount",),
    "gz": ("contract_amount", "contract_payment"),
    "buau": ("institution_payments_with_refund", "institution_payments_execution", "institution_payments_recovery"),
}
CODE_LABELS = {
    "kfsr_code": "КФСР", "kcsr_code": "КЦСР", "kvr_code": "КВР", "purpose_code": "коду цели",
    "funding_source": "источнику средств",
}
CODE_METRICS = {
    "kfsr_code": ("limits", "cash_payments", "obligations"),
    "kcsr_code": ("limits", "cash_payments"),
    "kvr_code": ("limits", "contract_amount"),
    "purpose_code": ("limits", "obligations"),
    "funding_source": ("limits", "cash_payments"),
}
DATE_RANGES = (
    ("с 01.01.2025 по 31.12.2025", "2025-01-01", "2025-12-31"),
    ("с 10.02.2025 по 01.05.2026", "2025-02-10", "2026-05-01"),
    ("за период с 01.03.2025 по 30.09.2025", "2025-03-01", "2025-09-30"),
)
DATED_METRICS = ("limits", "cash_payments", "agreement_amount", "contract_amount")
# Questions written by hand: text, metrics, grouping, filters and dates.
CURATED = (
    ("Покажи лимиты по Благовещенску по месяцам", ("limits",), ("month",), {"object_query": "Благовещенск"}),
    ("Покажи кассовые выплаты по 0502", ("cash_payments",), None, {"kfsr_code": "0502"}),
    ("Покажи сумму контрактов по источнику gz", ("contract_amount",), None, {"source_groups": ("gz",)}),
    ("Покажи соглашения по Авиабазе по годам", ("agreement_amount",), ("year",), {"object_query": "Авиабаза"}),
    ("Покажи данные по Благовещенску", None, None, {"object_query": "Благовещенск"}),
    ('Покажи кассовые выплаты по организации ГАУ Амурской области "Авиабаза"', ("cash_payments",), None,
     {"organization_query": 'ГАУ Амурской области "Авиабаза"'}),
    ("Покажи лимиты и кассовые выплаты по Благовещенску по месяцам", ("limits", "cash_payments"), ("month",),
     {"object_query": "Благовещенск"}),
    ("Покажи данные по документу 1211004698498", None, None, {"document_id": "1211004698498"}),
    ("Покажи сумму соглашений по номеру документа 637/1", ("agreement_amount",), None, {"document_number": "637/1"}),
    ("Покажи платежи по контрактам по источнику gz по месяцам", ("contract_payment",), ("month",), {"source_groups": ("gz",)}),
    ("Покажи выплаты БУАУ с учетом возврата по годам", ("institution_payments_with_refund",), ("year",), {}),
    ("Покажи исполнение БУАУ по организациям", ("institution_payments_execution",), ("organization_name",), {}),
    ("Покажи восстановление выплат БУАУ по источникам", ("institution_payments_recovery",), ("source_group",), {}),
    ("Покажи лимиты по бюджету города Благовещенска", ("limits",), None, {"budget_query": "Бюджет города Благовещенска"}),
    ("Покажи остаток лимитов по Благовещенску с 01.01.2025 по 31.12.2025", ("remaining_limits",), None,
     {"object_query": "Благовещенск", "date_from": "2025-01-01", "date_to": "2025-12-31"}),
    ("Покажи обязательства без БО по Тынде по годам", ("obligations_without_bo",), ("year",), {"object_query": "Тында"}),
)
TASK = "budget_query_to_json"
QUERY_HEADING, ANSWER_HEADING = "Запрос пользователя:", "Верни только JSON:"
SEED, VALIDATION_SHARE, MIN_VALIDATION = 42, 0.16, 12
# -----------------------------------------------------------------------------------------------

DEFAULT_INSTRUCTION = (
    "Преобразуй вопрос о бюджете в JSON с ключами date_from, date_to, metrics, filters, group_by.\n"
    f"Показатели: {', '.join(METRIC_PHRASES)}.\nФильтры: {', '.join(FILTER_KEYS)}."
)
SPLIT_BITS = 16

_S, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
TARGET_TYPE = T.StructType([
    T.StructField("date_from", _S), T.StructField("date_to", _S), T.StructField("metrics", _TEXTS),
    T.StructField("filters", T.StructType(
        [T.StructField(k, _TEXTS if k == "source_groups" else _S) for k in FILTER_KEYS])),
    T.StructField("group_by", _TEXTS),
])
RECORD_TYPE = T.StructType(
    [T.StructField(c, _S) for c in ("task", "text_query", "prompt", "completion")]
    + [T.StructField("target", TARGET_TYPE)]
)
# Catalogue field -> kind of subject (the filter it fills).
SUBJECT_KINDS = {
    "objects": "object_query", "organizations": "organization_query", "budgets": "budget_query",
    "source_groups": "source_groups", "kfsr_codes": "kfsr_code", "kcsr_codes": "kcsr_code", "kvr_codes": "kvr_code",
    "purpose_codes": "purpose_code", "funding_sources": "funding_source",
}


def subjects(facts: DataFrame) -> DataFrame:
    """What questions can be about: ``(kind, text, canonical)``, one pass over the facts."""
    columns = ("object_name", "organization_name", "budget_name", "source_group", *CODE_LABELS)
    values = catalogue(facts, columns)
    kinds = F.create_map(*[F.lit(x) for pair in SUBJECT_KINDS.items() for x in pair])
    return values.select(F.try_element_at(kinds, F.col("field")).alias("kind"),
                         F.col("value").alias("text"), F.col("value").alias("canonical"))


def curated(spark: SparkSession, questions=CURATED) -> DataFrame:
    """Questions written by hand as ``(text_query, target)``."""
    rows = [(text, (found.get("date_from"), found.get("date_to"), metrics and list(metrics), tuple(
        list(v) if isinstance(v := found.get(k), tuple) else v for k in FILTER_KEYS), group and list(group)))
        for text, metrics, group, found in questions]
    return spark.createDataFrame(rows, T.StructType([T.StructField("text_query", _S), T.StructField("target", TARGET_TYPE)]))


def _sections() -> dict[tuple[str, str | None], list[tuple]]:
    """(kind, one subject or all) -> (metric, verb, phrases, before, after, group, date_from, date_to)."""
    sections = {
        ("object_query", None): [
            (m, verb, METRIC_PHRASES[m], " по ", suffix, group, None, None)
            for m in SUBJECT_METRICS for verb in OBJECT_VERBS for group, suffix in GROUPINGS
        ] + [
            (m, None, METRIC_PHRASES[m][:1], " по ", f" {words}", None, start, end)
            for m in DATED_METRICS for words, start, end in DATE_RANGES
        ],
        ("organization_query", None): [
            (m, verb, METRIC_PHRASES[m], " по организации ", "", None, None, None)
            for m in SUBJECT_METRICS for verb in ORGANIZATION_VERBS
        ],
        ("budget_query", None): [(m, "", METRIC_PHRASES[m], " по ", "", None, None, None) for m in SUBJECT_METRICS],
    }
    for source, (first, second) in SOURCE_PHRASES.items():
        sections["source_groups", source] = [
            (m, None, METRIC_PHRASES[m][:1], f" {words}", suffix, group, None, None)
            for m in SOURCE_METRICS[source]
            for words, suffix, group in ((first, "", None), (second, " по месяцам", "month"))
        ]
    for code, label in CODE_LABELS.items():
        sections[code, None] = [
            (m, None, METRIC_PHRASES[m][:1], f" по {label} ", suffix, group, None, None)
            for m in CODE_METRICS[code] for group, suffix in ((None, ""), ("year", " по годам"))
        ]
    return sections


TEMPLATE_TYPE = (
    "array<struct<place int, metric string, verb string, phrases array<string>, before string, after string, "
    "`group` string, date_from string, date_to string>>"
)


def _templates() -> Column:
    """The templates that apply to a subject: a constant array per kind, parsed once while planning."""
    names = ("metric", "verb", "phrases", "before", "after", "group", "date_from", "date_to")
    choices = []
    for (kind, only), rows in _sections().items():
        text = json.dumps([{"place": i, **dict(zip(names, row))} for i, row in enumerate(rows)], ensure_ascii=False)
        applies = F.col("kind") == kind
        if only is not None:
            applies = applies & (F.col("canonical") == only)
        choices.append(F.when(applies, F.from_json(F.lit(text), TEMPLATE_TYPE)))
    return F.coalesce(*choices)


def _target(template: Column) -> Column:
    def listed(value: Column) -> Column:
        return F.when(value.isNotNull(), F.array(value))

    filters = F.struct(*[
        F.when(F.col("kind") == k, F.array("canonical") if k == "source_groups" else F.col("canonical")).alias(k)
        for k in FILTER_KEYS
    ])
    return F.struct(
        template["date_from"].alias("date_from"), template["date_to"].alias("date_to"),
        listed(template["metric"]).alias("metrics"), filters.alias("filters"),
        listed(template["group"]).alias("group_by"),
    ).cast(TARGET_TYPE)


def _question(template: Column) -> Column:
    pick = F.pmod(F.length("canonical") + F.length(template["verb"]), F.size(template["phrases"]))
    phrase = F.get(template["phrases"], F.coalesce(pick, F.lit(0)).cast("int"))
    verb = F.coalesce(F.nullif(template["verb"], F.lit("")), F.lit(OBJECT_VERBS[0]))
    named = F.when(F.col("kind") == "source_groups", "").otherwise(F.col("text"))
    return F.trim(F.concat(verb, F.lit(" "), phrase, template["before"], named, template["after"]))


def _surroundings() -> dict[str, list[tuple[int, str, str]]]:
    """What the templates of each kind put before and after a name, for every phrase."""
    return {
        kind: [(place, f"{row[1] or OBJECT_VERBS[0]} {phrase}{row[3]}", row[4]) for place, row in enumerate(rows) for phrase in row[2]]
        for (kind, only), rows in _sections().items() if kind != "source_groups" and only is None}


def _core(text: Column) -> Column:
    """A text without the template words at its ends. A question has the core of the name it is about, because templates
    put whole words around it; so equal questions are about names of one core."""
    around = [f"{row[1] or OBJECT_VERBS[0]} {phrase}{row[3]} {row[4]}" for rows in _sections().values() for row in rows for phrase in row[2]]
    words = F.split(text, " ", -1)
    own = F.transform(words, lambda w: ~w.isin(*sorted({"", *" ".join(around).split(" ")})))
    before, after = F.array_position(own, True) - 1, F.array_position(F.reverse(own), True) - 1
    return F.when(before < 0, "").otherwise(
        F.array_join(F.slice(words, F.greatest(before, F.lit(0)).cast("int") + 1, (F.size(words) - before - after).cast("int")), " "))


def _kinds_apart() -> tuple[dict[str, int], list[int]]:
    """Kinds none of whose questions about one name are equal, each as a bit, and the pairs of them that have equal ones."""
    parts = _surroundings()

    def clash(a: str, b: str) -> bool:
        return any(x[1:] == y[1:] and (a != b or x[0] != y[0]) for x in parts[a] for y in parts[b])

    fit = [kind for kind, some in parts.items() if not clash(kind, kind)
           and all(before.endswith(" ") and after[:1] in ("", " ") for _, before, after in some)]
    bits = {kind: 1 << i for i, kind in enumerate(fit)}
    return bits, [bits[a] | bits[b] for i, a in enumerate(fit) for b in fit[i + 1:] if clash(a, b)]


def _marked(subject: DataFrame, curated: DataFrame | None) -> DataFrame:
    """Subjects with ``apart``: whether no other question has the text of any question about them.

    That holds where all names of a core are the core itself, as then a text says what stands before and after the name,
    and where their kinds differ and put different words there. Only subjects are shuffled to find out.
    """
    bits, clashes = _kinds_apart()
    named = F.when(F.col("kind") != "source_groups", F.col("text"))
    bit = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(b)) for kind, b in bits.items()], F.lit(0))
    core = F.coalesce(_core(named), F.lit(""))
    own = subject.select("kind", "text", "canonical", core.alias("_core"), bit.alias("_bit"),
                         F.coalesce((core != "") & (core == named), F.lit(False)).alias("_plain"), F.lit(True).alias("_asked"))
    if curated is not None:
        empty = [F.lit(None).cast(_S).alias(c) for c in ("kind", "text", "canonical")]
        own = own.unionByName(curated.select(
            *empty, F.coalesce(_core(F.col("text_query")), F.lit("")).alias("_core"), F.lit(0).alias("_bit"),
            F.lit(False).alias("_plain"), F.lit(False).alias("_asked")))
    # Names are few bytes but many questions each, so they are dealt over all tasks.
    own, same = dealt(own, "_core"), Window.partitionBy("_core")
    kinds = F.bit_or("_bit").over(same)
    apart = F.bool_and("_plain").over(same) & (F.bit_count(kinds) == F.count(F.lit(1)).over(same))
    for both in clashes:
        apart = apart & (kinds.bitwiseAND(F.lit(both)) != both)
    return own.withColumn("apart", apart).where("_asked").select("kind", "text", "canonical", "apart")


def examples(subject: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """``(text_query, position, target)``; of two equal texts the later answer stays. ``curated`` rows come first.

    Only questions that may have the text of another are compared, by text and position; their answers follow from these.
    All others leave the task that makes them.
    """
    template, marked = F.col("t"), _marked(subject, curated)
    position = F.struct(F.lit(1).alias("section"), "kind", F.col("canonical").alias("subject"), template["place"].alias("place"))
    every = marked.withColumn("t", F.explode(_templates()))
    apart = every.where("apart").select(
        _question(template).alias("text_query"), position.alias("position"), _target(template).alias("target"))

    given = F.lit(None).cast(TARGET_TYPE).alias("given")
    shared = every.where("not apart").select(_question(template).alias("text_query"), position.alias("position"), given)
    if curated is not None:
        shared = shared.unionByName(curated.select(
            "text_query",
            F.struct(F.lit(0).alias("section"), F.lit("").alias("kind"), F.col("text_query").alias("subject"),
                     F.lit(0).alias("place")).alias("position"),
            F.col("target").cast(TARGET_TYPE).alias("given")))
    last = shared.groupBy("text_query").agg(
        F.min("position").alias("position"), F.max("position").alias("last"), F.max_by("given", "position").alias("given"))
    answered = last.select("text_query", "position", "last", "given", F.col("last.kind").alias("kind"), F.col("last.subject").alias("canonical"))
    made = _target(F.get(_templates(), F.col("last.place")))
    return apart.unionByName(answered.select(
        "text_query", "position", F.when(F.col("last.section") == 0, F.col("given")).otherwise(made).alias("target")))


# --- Records -----------------------------------------------------------------------------------


def _json_text(value: Column) -> Column:
    quoted = F.to_json(F.array(value))
    return F.when(value.isNull(), "null").otherwise(F.substring(quoted, 2, 1 << 30).substr(F.lit(1), F.length(quoted) - 2))


def _json_list(values: Column, indent: int) -> Column:
    inner, outer = "\n" + " " * (indent + 2), "\n" + " " * indent
    items = F.array_join(F.transform(values, _json_text), "," + inner)
    return F.when(values.isNull(), "null").when(F.size(values) == 0, "[]").otherwise(
        F.concat(F.lit("[" + inner), items, F.lit(outer + "]")))


def _json_object(pairs: list[tuple[str, Column]], indent: int) -> Column:
    inner, outer = "\n" + " " * (indent + 2), "\n" + " " * indent
    lines = [F.concat(F.lit(f'"{name}": '), value) for name, value in pairs]
    return F.concat(F.lit("{" + inner), F.concat_ws("," + inner, *lines), F.lit(outer + "}"))


def completion(target: Column) -> Column:
    """The answer as JSON text with two-space indentation and explicit nulls."""
    filters = _json_object([
        (k, _json_list(target["filters"][k], 4) if k == "source_groups" else _json_text(target["filters"][k]))
        for k in FILTER_KEYS], 2)
    return _json_object([
        ("date_from", _json_text(target["date_from"])), ("date_to", _json_text(target["date_to"])),
        ("metrics", _json_list(target["metrics"], 2)), ("filters", filters),
        ("group_by", _json_list(target["group_by"], 2))], 0)


def records(example: DataFrame, instruction: str = DEFAULT_INSTRUCTION) -> DataFrame:
    prompt = F.concat(F.lit(f"{instruction}\n\n{QUERY_HEADING}\n"), "text_query", F.lit(f"\n\n{ANSWER_HEADING}"))
    return example.select(
        F.lit(TASK).alias("task"), "text_query", prompt.alias("prompt"),
        completion(F.col("target")).alias("completion"), "target")


def split_hash(text: Column, seed: int) -> Column:
    """Sixty bits of a digest of seed and text (BIGINT, not negative), the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, 15), 16, 10).cast("bigint")


def split(record: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``split``: exactly max(12, 16 %) records are validation, those with the smallest seeded hashes.

    The border of the global order is found from counts per range of hashes, for which the texts alone are read. Records of
    all ranges but the one that holds the border are placed where they are; those of that range alone are shuffled and ranked.
    """
    hashed = record.withColumn("_hash", split_hash(F.col("text_query"), seed)).withColumn(
        "_bucket", F.shiftright("_hash", 60 - SPLIT_BITS))
    # At most 2^SPLIT_BITS rows, whatever the data: bounded windows and a bounded broadcast.
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = F.greatest(F.lit(MIN_VALIDATION), F.floor(F.sum("_size").over(Window.partitionBy(F.lit(0))) * F.lit(VALIDATION_SHARE)))
    bounds = sizes.select("_bucket", "_size", (quota - F.coalesce(F.sum("_size").over(before), F.lit(0))).alias("_open"))
    placed = hashed.join(F.broadcast(bounds), "_bucket")
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", "text_query"))
    holds_border = (F.col("_open") > 0) & (F.col("_open") < F.col("_size"))
    ranked = placed.where(holds_border).withColumn("_rank", rank)
    whole = placed.where(~holds_border).withColumn("_rank", F.lit(1))
    name = F.when(F.col("_rank") <= F.col("_open"), "validation").otherwise("train")
    return whole.unionByName(ranked).withColumn("split", name).select(*record.columns, "split")


def training_text(record: DataFrame) -> DataFrame:
    return record.withColumn("text", F.concat(F.coalesce("prompt", F.lit("")), F.coalesce("completion", F.lit(""))))


def audit(record: DataFrame) -> DataFrame:
    """One row of counts: records whose prompt lacks the text, or whose completion lacks a required key."""
    answer = F.try_parse_json("completion")
    keys = F.json_object_keys("completion")
    filter_keys = F.json_object_keys(F.get_json_object("completion", "$.filters"))

    def lacks(found: Column, wanted) -> Column:
        missing = F.size(F.array_except(F.array(*[F.lit(k) for k in wanted]), found)) > 0
        return F.coalesce(missing, F.lit(True))

    return record.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(~F.contains("prompt", F.col("text_query"))).alias("text_not_in_prompt"),
        F.count_if(lacks(keys, TARGET_TYPE.fieldNames())).alias("missing_root_keys"),
        F.count_if(lacks(filter_keys, FILTER_KEYS)).alias("missing_filter_keys"),
        F.count_if(answer.isNull()).alias("invalid_json"),
    )


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def manifest(split_records: DataFrame, instruction: str = DEFAULT_INSTRUCTION) -> DataFrame:
    """One row that describes a data set."""
    def of(name: str) -> Column:
        return F.count_if(F.col("split") == name)

    return split_records.agg(
        F.lit(TASK).alias("task"), F.count(F.lit(1)).alias("total_records"), of("train").alias("train_records"),
        of("validation").alias("validation_records"),
        F.lit(SEED).alias("seed"), F.lit(VALIDATION_SHARE).alias("validation_share"),
        F.array(*[F.lit(k) for k in TARGET_TYPE.fieldNames()]).alias("root_keys"),
        F.array(*[F.lit(k) for k in FILTER_KEYS]).alias("filter_keys"), F.lit(instruction).alias("instruction"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSONL folder. The schema is explicit: fields that are null throughout keep their type."""
    return spark.read.schema(RECORD_TYPE).json(path)
