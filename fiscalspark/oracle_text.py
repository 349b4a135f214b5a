"""SQL equivalents of the question and training queries."""

from __future__ import annotations

import json

from fiscalspark.oracle import MONEY, SQL, on_facts, percent
from fiscalspark.plans import training as G
from fiscalspark.plans.resolve import UNAVAILABLE
from fiscalspark.queries_text import ENDINGS, SUBJECT_WORDS
from fiscalspark.schema import TEXT_SEARCH_COLUMNS

N = "COUNT(*) AS n"

# --- Fixed values: what the questions' language is expected to be, apart from the code under test ---
STOPWORDS = (
    "а", "был", "была", "были", "было", "в", "во", "выплат", "выплата", "выплаты", "где", "год", "года", "годам",
    "году", "данные", "для", "до", "за", "из", "и", "или", "источник", "источникам", "источники", "источнику",
    "итого", "как", "какая", "какие", "какой", "кассовые", "кассовых", "контракт", "контрактам", "контрактов",
    "лимит", "лимиты", "месяц", "месяцам", "на", "об", "от", "по", "покажи", "показать", "получено", "потрачен",
    "потрачено", "потраченные", "потратили", "оплат", "оплата", "платеж", "платежи", "про", "договор",
    "договоров", "обязательства", "остаток", "нибудь", "расход", "расходы", "сколько", "средств", "сумма",
    "суммарно", "суммы", "соглашений", "соглашения", "тема", "теме", "темой", "тему", "траты", "что", "это",
)
SUFFIXES = (
    "иями", "ями", "ами", "ого", "ему", "ыми", "ими", "ской", "скому", "ские", "ский", "ская", "ское", "его",
    "ому", "ой", "ей", "ая", "яя", "ое", "ее", "ые", "ие", "ом", "ем", "ам", "ям", "ах", "ях", "ов", "ев", "ий",
    "ый", "ую", "юю", "а", "я", "ы", "и", "у", "ю", "е", "о",
)
METRIC_HINTS = {
    "cash_payments": ("кассов", "выбыти", "расход", "потра", "трат"),
    "limits": ("лимит",),
    "agreement_amount": ("соглаш",),
    "contract_amount": ("контракт", "договор"),
    "contract_payment": ("платеж", "оплат"),
    "obligations_without_bo": ("без бо",),
    "obligations": ("обязатель", "бо"),
    "remaining_limits": ("остаток лимит",),
}
INTERPRETATION_ORDER = ("limits", "cash_payments")
GROUP_BY_HINTS = {
    "month": ("по месяц", "помесяч", "ежемесяч"),
    "year": ("по год", "ежегод"),
    "day": ("по дням", "по датам", "по дня"),
}
# -----------------------------------------------------------------------------------------------


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


QUESTIONS = (
    f"questions AS (SELECT o_orderkey AS query_id, 'Покажи ' || ({_list(SUBJECT_WORDS)})[o_orderkey % {len(SUBJECT_WORDS)} "
    "+ 1] || ' по ' || CASE o_orderkey % 3 WHEN 0 THEN 'nation_' || c_nationkey WHEN 1 THEN lower(c_mktsegment) ELSE "
    f"'view' END || ({_list(ENDINGS)})[(o_orderkey % 11) % {len(ENDINGS)} + 1] AS text_query "
    "FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"
)
_FOLDED = "replace(lower(text_query), 'ё', 'е')"
# The first listed ending that leaves four letters goes.
_STEM = "CASE " + " ".join(
    f"WHEN ends_with(w, '{s}') AND length(w) >= {4 + len(s)} THEN left(w, length(w) - {len(s)})" for s in SUFFIXES) + " ELSE w END"
_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


def terms(source: str, key: str, text: str) -> str:
    """Ordered distinct stems per key, as (key, terms, n)."""
    return (
        f"(SELECT {key}, string_agg(s, ' ' ORDER BY p) AS terms, COUNT(*) AS n FROM (SELECT {key}, s, MIN(p) AS p FROM "
        f"(SELECT {key}, p, {_STEM} AS s FROM (SELECT {key}, replace(lower(t), 'ё', 'е') AS w, p FROM (SELECT {key}, "
        f"unnest(regexp_extract_all({text}, '[A-Za-zА-Яа-яЁё0-9]+')) AS t, generate_subscripts(regexp_extract_all("
        f"{text}, '[A-Za-zА-Яа-яЁё0-9]+'), 1) AS p FROM {source})) WHERE length(w) >= 3 AND NOT regexp_matches(w, '[0-9]') "
        f"AND w NOT IN {_STOP}) WHERE length(s) >= 3 AND s NOT IN {_STOP} GROUP BY {key}, s) GROUP BY {key})"
    )


SQL["text_terms"] = (
    "SELECT d.doc_id, coalesce(n, 0) AS n, md5(coalesce(terms, '')) AS digest FROM documents d LEFT JOIN "
    + terms("documents", "doc_id", "text") + " t ON d.doc_id = t.doc_id")
_QUESTION_TERMS = terms("questions", "query_id", "text_query")
SQL["question_terms"] = (
    f"WITH {QUESTIONS} SELECT coalesce(terms, '') AS terms, {N} FROM questions q LEFT JOIN {_QUESTION_TERMS} t "
    "ON q.query_id = t.query_id GROUP BY 1")
SQL["text_stem"] = (
    f"WITH {QUESTIONS} SELECT {_STEM} AS stem, {N} FROM (SELECT unnest(regexp_extract_all(lower(text_query), '[а-яё]+')) "
    "AS w FROM questions) GROUP BY 1")


def _hints(text: str, hints: dict[str, tuple[str, ...]]) -> str:
    return "CASE " + " ".join(
        f"WHEN {' OR '.join(f'contains({text}, {w!r})' for w in words)} THEN '{name}'" for name, words in hints.items()
    ) + " END"


_ORDERED = {m: METRIC_HINTS[m] for m in (*INTERPRETATION_ORDER, *METRIC_HINTS)}
SQL["infer_metric"] = f"WITH {QUESTIONS} SELECT {_hints(_FOLDED, METRIC_HINTS)} AS metric, {N} FROM questions GROUP BY 1"
SQL["infer_metric_interp"] = (
    f"WITH {QUESTIONS} SELECT {_hints('f', _ORDERED)} AS metric, {N} FROM (SELECT {_FOLDED} || CASE WHEN query_id % 2 = 0 "
    "THEN ' и расходы' ELSE ' и лимиты' END AS f FROM questions) GROUP BY 1")
SQL["infer_group_by"] = f"WITH {QUESTIONS} SELECT {_hints(_FOLDED, GROUP_BY_HINTS)} AS group_by, {N} FROM questions GROUP BY 1"
# The questions name one year only in the endings "за 1997 год" and "2025, 2025".
_YEAR = "CASE WHEN text_query LIKE '%за 1997 год' THEN 1997 WHEN text_query LIKE '%2025, 2025' THEN 2025 END"
SQL["infer_year_range"] = (
    f"WITH {QUESTIONS} SELECT make_date(y, 1, 1) AS date_from, make_date(y, 12, 31) AS date_to, {N} FROM "
    f"(SELECT {_YEAR} AS y FROM questions) GROUP BY 1, 2")

OPTIONS = (
    "subjects AS (SELECT DISTINCT replace(lower(v), 'ё', 'е') AS v FROM (SELECT object_name AS v FROM facts UNION ALL "
    "SELECT budget_name FROM facts) WHERE v <> ''), organizations AS (SELECT DISTINCT replace(lower(organization_name), "
    "'ё', 'е') AS v FROM facts WHERE organization_name <> '')"
)
_WORDS = (
    "words AS (SELECT query_id, unnest(regexp_extract_all(text_query, '[A-Za-zА-Яа-я0-9Ёё-]+')) AS w, generate_subscripts("
    "regexp_extract_all(text_query, '[A-Za-zА-Яа-я0-9Ёё-]+'), 1) AS p FROM questions), known AS (SELECT w FROM (SELECT "
    "DISTINCT w FROM words WHERE length(w) >= 4) d WHERE EXISTS (SELECT 1 FROM subjects WHERE contains(v, replace(lower(w), "
    "'ё', 'е')))), inferred AS (SELECT query_id, arg_min(w, p) AS inferred_object FROM words WHERE w IN (SELECT w FROM known) "
    "GROUP BY query_id)"
)
SQL["resolve_object_terms"] = on_facts("SELECT query_id, inferred_object FROM inferred", QUESTIONS, OPTIONS, _WORDS)

_ASKED = (
    "asked AS (SELECT *, CASE query_id % 4 WHEN 0 THEN 'NATION_1' WHEN 1 THEN 'supplier#00000000' WHEN 2 THEN 'лишнее' END "
    "AS org, CASE WHEN query_id % 5 = 0 THEN 'cash_payments' END AS p_metric, CASE WHEN query_id % 2 = 0 THEN 'month' ELSE "
    "'object_name' END AS p_group, CASE WHEN query_id % 6 = 0 THEN DATE '1996-01-01' END AS e_from, "
    "CASE WHEN query_id % 7 = 0 THEN 'R' END AS e_kvr, CASE WHEN query_id % 9 = 0 THEN 'limits' END AS e_metric, "
    "CASE WHEN query_id % 10 = 0 THEN 'year' END AS e_group FROM questions)"
)
SQL["reclassify_org"] = on_facts(
    f"SELECT query_id, coalesce(p_metric, {_hints(_FOLDED, _ORDERED)}) AS metrics, coalesce({_hints(_FOLDED, GROUP_BY_HINTS)}, "
    "nullif(p_group, 'month')) AS group_by, CASE WHEN NOT moves THEN org END AS organization_query, "
    "CASE WHEN moves THEN coalesce(inferred_object, org) WHEN org IS NULL THEN inferred_object END AS object_query FROM "
    "(SELECT a.*, inferred_object, coalesce(org IN (SELECT org FROM of_object) AND org NOT IN (SELECT org FROM of_org), FALSE) "
    "AS moves FROM asked a LEFT JOIN inferred i ON a.query_id = i.query_id)",
    QUESTIONS, OPTIONS, _WORDS, _ASKED,
    "of_object AS (SELECT DISTINCT org FROM (SELECT DISTINCT org FROM asked WHERE org IS NOT NULL) WHERE EXISTS (SELECT 1 FROM subjects "
    "WHERE contains(v, lower(org))))",
    "of_org AS (SELECT DISTINCT org FROM (SELECT DISTINCT org FROM asked WHERE org IS NOT NULL) WHERE EXISTS (SELECT 1 FROM organizations "
    "WHERE contains(v, lower(org))))",
)
SQL["merge_request_patch"] = (
    f"WITH {QUESTIONS}, {_ASKED} SELECT query_id, e_from AS date_from, CAST(NULL AS DATE) AS date_to, coalesce(e_metric, "
    "p_metric) AS metrics, coalesce(e_group, p_group) AS group_by, org AS organization_query, e_kvr AS kvr_code, "
    "CAST(NULL AS VARCHAR) AS text_search FROM asked")
SQL["merge_page_fields"] = (
    f"WITH {QUESTIONS} SELECT query_id, CAST(CASE WHEN query_id % 3 = 0 THEN 25 WHEN query_id % 4 < 2 THEN query_id % 1000 + 1 ELSE 100 "
    'END AS INTEGER) AS "limit", CAST(CASE WHEN query_id % 8 = 0 THEN query_id ELSE 0 END AS INTEGER) AS "offset", CASE WHEN query_id % 7 < 3 '
    "THEN query_id % 2 = 0 WHEN query_id % 5 < 2 THEN FALSE ELSE TRUE END AS include_rows, query_id % 11 <> 0 AS include_charts FROM questions")


def _safe(patched: bool) -> str:
    metric, group, org = ("p_metric", "p_group", "org") if patched else ("NULL", "'month'", "NULL")
    subject = f"({org} IS NOT NULL OR e_kvr IS NOT NULL)"
    extra = "" if patched else f", FALSE AS interpreted, '{UNAVAILABLE}' AS warning"
    return (
        f"WITH {QUESTIONS}, {_ASKED} SELECT a.query_id, coalesce(e_from, make_date({_YEAR}, 1, 1)) AS date_from, "
        f"CASE WHEN e_from IS NULL THEN make_date({_YEAR}, 12, 31) END AS date_to, coalesce(e_metric, {metric}, "
        f"{_hints(_FOLDED, METRIC_HINTS)}) AS metrics, coalesce(e_group, {group}) AS group_by, CAST({org} AS VARCHAR) AS "
        f"organization_query, e_kvr AS kvr_code, CASE WHEN NOT {subject} THEN terms END AS text_search{extra} "
        f"FROM asked a LEFT JOIN {_QUESTION_TERMS} t ON a.query_id = t.query_id"
    )


SQL["resolve_safety"] = _safe(True)
SQL["resolve_no_interpretation"] = _safe(False)
_METRIC_REPLY = (
    """CASE o_orderkey % 3 WHEN 0 THEN '["Limits", "nope", "limits", "contract_amount"]' WHEN 1 THEN '" LIMITS "' ELSE 'null' END""")
SQL["extract_reply_json"] = (
    f"""SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 4 <> 3 THEN '{{"metrics": ' || {_METRIC_REPLY} || """
    """', "filters": {"source_groups": "GZ", "document_id": [null, " ' || o_orderkey || ' "]}, "group_by": ["year", "x"]}' END """
    "AS json FROM orders")
SQL["coerce_interpretation"] = (
    "SELECT o_orderkey AS query_id, CASE WHEN ok THEN CASE o_orderkey % 3 WHEN 0 THEN 'limits,contract_amount' WHEN 1 THEN "
    "'limits' END END AS metrics, CASE WHEN ok THEN 'year' END AS group_by, CASE WHEN ok THEN 'gz' END AS source_groups, "
    "CASE WHEN ok THEN CAST(o_orderkey AS VARCHAR) END AS document_id FROM (SELECT *, o_orderkey % 4 <> 3 AS ok FROM orders)")
SQL["coerce_flags"] = (
    "SELECT o_orderkey % 10 AS bucket, CASE o_orderkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 3 THEN FALSE ELSE "
    f"o_orderkey % 2 = 1 END AS changed, {N} FROM orders GROUP BY 1, 2")
SQL["canonical_lists"] = (
    f"SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'gz,rchb' ELSE 'gz' END AS source_groups, {N} FROM orders GROUP BY 1")
SQL["reply_is_json"] = f"SELECT o_orderkey % 4 <> 3 AS valid, {N} FROM orders GROUP BY 1"


def _answer(tag: str, where: str, dims: tuple[str, ...] = ("year", "month")) -> str:
    """All parts of the answer to one request over the facts."""
    base, columns = f"(SELECT * FROM facts WHERE {where})", ", ".join(dims)
    null = "CAST(NULL AS {})".format
    rows = ", ".join(d if d in dims else f"{null('INTEGER')} AS {d}" for d in ("year", "month"))
    return " UNION ALL ".join((
        f"SELECT {tag}, 'summary' AS part, {null('INTEGER')} AS year, {null('INTEGER')} AS month, {null('VARCHAR')} AS period, "
        f"{null('VARCHAR')} AS source_group, metric, {MONEY} AS value FROM {base} GROUP BY metric",
        f"SELECT {tag}, 'rows', {rows}, NULL, NULL, metric, {MONEY} FROM {base} GROUP BY metric, {columns}",
        f"SELECT {tag}, 'timeseries', NULL, NULL, printf('%04d-%02d', year, month), NULL, metric, {MONEY} FROM {base} "
        "WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY metric, year, month",
        f"SELECT DISTINCT {tag}, 'source', NULL::INTEGER, NULL::INTEGER, NULL, source_group, NULL, NULL::DECIMAL(20,2) FROM {base}",
        f"SELECT {tag}, 'execution', NULL, NULL, NULL, NULL, NULL, {percent('c', 'l')} FROM (SELECT "
        "SUM(CASE WHEN metric = 'cash_payments' THEN value END) AS c, SUM(CASE WHEN metric = 'limits' THEN value END) AS l, "
        f"COUNT(*) AS n FROM {base}) WHERE n > 0"))


SQL["prepared_examples"] = on_facts(" UNION ALL ".join(
    _answer(f"'{prompt}' AS prompt, '{title}' AS title", condition)
    for prompt, title, condition in (
        ("Покажи лимиты по Благовещенску по месяцам", "Лимиты по Благовещенску",
         "metric = 'limits' AND (object_name ILIKE '%NATION_1%' OR budget_name ILIKE '%NATION_1%')"),
        ("Покажи кассовые выплаты по 0502", "Кассовые выплаты по 0502", "metric = 'cash_payments' AND kfsr_code = 'Brand#7'"),
        ("Покажи сумму контрактов по источнику gz", "Контракты по gz", "metric = 'contract_amount' AND source_group = 'gz'"),
    )))
_SUBJECTS = (
    "asked AS (SELECT o_orderkey AS query_id, ['limits', 'cash_payments', 'contract_amount'][o_orderkey % 3 + 1] AS metric, "
    "CAST(year(o_orderdate) AS INTEGER) AS y, o_orderkey % 5 = 0 AS by_year, CASE WHEN o_orderkey % 4 = 0 THEN n_name END AS object, "
    "CASE WHEN o_orderkey % 4 = 1 THEN ['A', 'N', 'R'][o_orderkey % 7 % 3 + 1] END AS kvr, CASE WHEN o_orderkey % 4 = 2 THEN c_mktsegment END "
    "AS segment, CASE WHEN o_orderkey % 4 = 3 THEN lower(c_mktsegment) END AS word FROM orders LEFT JOIN customer ON o_custkey = c_custkey "
    "LEFT JOIN nation ON c_nationkey = n_nationkey), requests AS (SELECT *, row_number() OVER () AS r FROM (SELECT DISTINCT metric, y, by_year, "
    "object, kvr, segment, word FROM asked))")
_TEXT = "lower(concat_ws(chr(1), " + ", ".join(TEXT_SEARCH_COLUMNS) + ", raw_text))"
_CELLS = (
    f"cells AS (SELECT metric, year, month, source_group, object_name, budget_name, kvr_code, funding_source, {_TEXT} AS t, SUM(value) AS value "
    "FROM facts WHERE metric IN ('limits', 'cash_payments', 'contract_amount') GROUP BY ALL), met AS (SELECT r, by_year, c.metric, c.year, "
    "c.month, c.source_group, c.value FROM requests q JOIN cells c ON c.metric = q.metric AND c.year = q.y WHERE (object IS NULL OR "
    "coalesce(object_name ILIKE '%' || object || '%', FALSE) OR coalesce(budget_name ILIKE '%' || object || '%', FALSE)) AND (kvr IS NULL OR "
    "kvr_code = kvr) AND (segment IS NULL OR funding_source = segment) AND (word IS NULL OR contains(t, word)))")
_NO = "CAST(NULL AS VARCHAR)"
_PARTS = " UNION ALL ".join((
    f"SELECT r, 'summary' AS part, {MONEY} AS value, NULL::BIGINT AS months, {_NO} AS named FROM met GROUP BY r, metric",
    f"SELECT r, 'rows', {MONEY}, year * 12 + CASE WHEN by_year THEN 0 ELSE month END, NULL FROM met GROUP BY r, by_year, metric, year, "
    "CASE WHEN by_year THEN 0 ELSE month END",
    f"SELECT r, 'timeseries', {MONEY}, NULL, printf('%04d-%02d', year, month) FROM met GROUP BY r, metric, year, month",
    "SELECT r, 'source', NULL, NULL, source_group FROM met GROUP BY r, source_group",
    f"SELECT r, 'execution', {percent('c', 'l')}, NULL, NULL FROM (SELECT r, SUM(CASE WHEN metric = 'cash_payments' THEN value END) AS c, "
    "SUM(CASE WHEN metric = 'limits' THEN value END) AS l FROM met GROUP BY r)"))
SQL["answer_questions"] = on_facts(
    "SELECT query_id, part, n, total, months, named FROM asked a JOIN requests q ON a.metric = q.metric AND a.y = q.y AND a.by_year = q.by_year "
    "AND a.object IS NOT DISTINCT FROM q.object AND a.kvr IS NOT DISTINCT FROM q.kvr AND a.segment IS NOT DISTINCT FROM q.segment AND "
    "a.word IS NOT DISTINCT FROM q.word JOIN (SELECT r, part, COUNT(*) AS n, SUM(value) AS total, SUM(months)::BIGINT AS months, "
    "coalesce(string_agg(DISTINCT named, ',' ORDER BY named), '') AS named FROM parts GROUP BY r, part) p ON p.r = q.r",
    _SUBJECTS, _CELLS, f"parts AS ({_PARTS})")

# --- Training sets -----------------------------------------------------------------------------


def _values(name: str, column: str) -> str:
    return f"SELECT DISTINCT {column} AS subject FROM facts WHERE {column} <> ''"


def _phrase(metric: str, verb: str) -> str:
    phrases = G.METRIC_PHRASES[metric]
    return f"({_list(phrases)})[(length(subject) + {len(verb)}) % {len(phrases)} + 1]"


def _section(key: str, source: str, text: str, metric: str, group: str | None, start: str | None = None, end: str | None = None) -> str:
    def literal(value):
        return f"'{value}'" if value else "CAST(NULL AS VARCHAR)"

    return (f"SELECT {text} AS text_query, '{metric}' AS metric, {literal(group)} AS group_by, {literal(start)} AS date_from, "
            f"{literal(end)} AS date_to, subject, '{key}' AS key FROM {source}")


def _training_sections() -> str:
    parts = []
    for metric in G.SUBJECT_METRICS:
        for verb in G.OBJECT_VERBS:
            for group, suffix in G.GROUPINGS:
                parts.append(_section("object_query", "objects", f"'{verb} ' || {_phrase(metric, verb)} || ' по ' || subject || '{suffix}'", metric, group))
        for verb in G.ORGANIZATION_VERBS:
            parts.append(_section("organization_query", "orgs", f"'{verb} ' || {_phrase(metric, verb)} || ' по организации ' || subject", metric, None))
        parts.append(_section("budget_query", "budgets", f"'Покажи ' || {_phrase(metric, '')} || ' по ' || subject", metric, None))
    for source, (first, second) in G.SOURCE_PHRASES.items():
        for metric in G.SOURCE_METRICS[source]:
            phrase = G.METRIC_PHRASES[metric][0]
            of = f"(SELECT subject FROM groups WHERE subject = '{source}')"
            parts.append(_section("source_groups", of, f"'Покажи {phrase} {first}'", metric, None))
            parts.append(_section("source_groups", of, f"'Покажи {phrase} {second} по месяцам'", metric, "month"))
    for code, label in G.CODE_LABELS.items():
        for metric in G.CODE_METRICS[code]:
            text = f"'Покажи {G.METRIC_PHRASES[metric][0]} по {label} ' || subject"
            parts.append(_section(code, f"(SELECT DISTINCT {code} AS subject FROM facts WHERE {code} <> '')", text, metric, None))
            parts.append(_section(code, f"(SELECT DISTINCT {code} AS subject FROM facts WHERE {code} <> '')", text + " || ' по годам'", metric, "year"))
    for metric in G.DATED_METRICS:
        for words, start, end in G.DATE_RANGES:
            parts.append(_section("object_query", "objects", f"'Покажи {G.METRIC_PHRASES[metric][0]} по ' || subject || ' {words}'", metric, None, start, end))
    return " UNION ALL ".join(parts)


_TRAINING = (
    f"objects AS ({_values('objects', 'object_name')})", f"orgs AS ({_values('orgs', 'organization_name')})",
    f"budgets AS ({_values('budgets', 'budget_name')})", f"groups AS ({_values('groups', 'source_group')})",
    f"examples AS ({_training_sections()})",
)
SQL["training_examples"] = on_facts("SELECT * EXCLUDE (key) FROM examples", *_TRAINING)
SQL["training_records"] = on_facts(
    f"SELECT metric, group_by, {N}, COUNT(*) AS with_text FROM examples GROUP BY 1, 2", *_TRAINING)
#: The questions written by hand and their answers, apart from the code under test: (text, metrics, grouping, what else is not null).
_BY_HAND = (
    ("Покажи лимиты по Благовещенску по месяцам", ["limits"], ["month"], {"object_query": "Благовещенск"}),
    ("Покажи кассовые выплаты по 0502", ["cash_payments"], None, {"kfsr_code": "0502"}),
    ("Покажи сумму контрактов по источнику gz", ["contract_amount"], None, {"source_groups": ["gz"]}),
    ("Покажи соглашения по Авиабазе по годам", ["agreement_amount"], ["year"], {"object_query": "Авиабаза"}),
    ("Покажи данные по Благовещенску", None, None, {"object_query": "Благовещенск"}),
    ('Покажи кассовые выплаты по организации ГАУ Амурской области "Авиабаза"', ["cash_payments"], None,
     {"organization_query": 'ГАУ Амурской области "Авиабаза"'}),
    ("Покажи лимиты и кассовые выплаты по Благовещенску по месяцам", ["limits", "cash_payments"], ["month"], {"object_query": "Благовещенск"}),
    ("Покажи данные по документу 1211004698498", None, None, {"document_id": "1211004698498"}),
    ("Покажи сумму соглашений по номеру документа 637/1", ["agreement_amount"], None, {"document_number": "637/1"}),
    ("Покажи платежи по контрактам по источнику gz по месяцам", ["contract_payment"], ["month"], {"source_groups": ["gz"]}),
    ("Покажи выплаты БУАУ с учетом возврата по годам", ["institution_payments_with_refund"], ["year"], {}),
    ("Покажи исполнение БУАУ по организациям", ["institution_payments_execution"], ["organization_name"], {}),
    ("Покажи восстановление выплат БУАУ по источникам", ["institution_payments_recovery"], ["source_group"], {}),
    ("Покажи лимиты по бюджету города Благовещенска", ["limits"], None, {"budget_query": "Бюджет города Благовещенска"}),
    ("Покажи остаток лимитов по Благовещенску с 01.01.2025 по 31.12.2025", ["remaining_limits"], None,
     {"object_query": "Благовещенск", "date_from": "2025-01-01", "date_to": "2025-12-31"}),
    ("Покажи обязательства без БО по Тынде по годам", ["obligations_without_bo"], ["year"], {"object_query": "Тында"}),
)
_FILTERS = (
    "source_groups", "object_query", "budget_query", "organization_query", "document_id", "document_number", "kfsr_code", "kcsr_code",
    "kvr_code", "kvsr_code", "kesr_code", "kosgu_code", "purpose_code", "funding_source")


def _answer_text(metrics, group, found) -> str:
    return json.dumps({"date_from": found.get("date_from"), "date_to": found.get("date_to"), "metrics": metrics,
                       "filters": {k: found.get(k) for k in _FILTERS}, "group_by": group}, ensure_ascii=False, indent=2)


def _answer_sql() -> str:
    """The same text from the columns of an example."""
    def quoted(column: str) -> str:
        return f"coalesce('\"' || replace(replace({column}, '\\', '\\\\'), '\"', '\\\"') || '\"', 'null')"

    def listed(column: str, indent: int) -> str:
        inner, outer = "chr(10) || '" + " " * (indent + 2) + "'", "chr(10) || '" + " " * indent + "'"
        return f"CASE WHEN {column} IS NULL THEN 'null' ELSE '[' || {inner} || {quoted(column)} || {outer} || ']' END"

    def only(key: str) -> str:
        return f"CASE WHEN key = '{key}' THEN subject END"

    filters = " || ',' || chr(10) || '    ' || ".join(
        f"'\"{k}\": ' || " + (listed(f"({only(k)})", 4) if k == "source_groups" else quoted(f"({only(k)})")) for k in _FILTERS)
    parts = [f"'\"date_from\": ' || {quoted('date_from')}", f"'\"date_to\": ' || {quoted('date_to')}",
             f"'\"metrics\": ' || {listed('metric', 2)}", f"'\"filters\": {{' || chr(10) || '    ' || {filters} || chr(10) || '  }}'",
             f"'\"group_by\": ' || {listed('group_by', 2)}"]
    return "'{' || chr(10) || '  ' || " + " || ',' || chr(10) || '  ' || ".join(parts) + " || chr(10) || '}'"


_HAND_ROWS = ", ".join(f"('{t}', '{_answer_text(m, g, f)}')" for t, m, g, f in _BY_HAND)
_PROMPT = "'?' || chr(10) || chr(10) || 'Запрос пользователя:' || chr(10) || text_query || chr(10) || chr(10) || 'Верни только JSON:'"
SQL["training_answers"] = on_facts(
    f"SELECT text_query, completion, {_PROMPT} AS prompt, md5({_PROMPT} || completion) AS text_md5 FROM (SELECT text_query, {_answer_sql()} AS "
    f"completion FROM examples UNION ALL SELECT * FROM (VALUES {_HAND_ROWS}) AS hand(text_query, completion) "
    "WHERE text_query NOT IN (SELECT text_query FROM examples))", *_TRAINING)
_SIZE = "greatest(12, CAST(floor(COUNT(*) * 0.16) AS BIGINT))"
SQL["train_val_split"] = on_facts(
    "SELECT text_query, CASE WHEN row_number() OVER (ORDER BY h, text_query) <= size THEN 'validation' ELSE 'train' END AS split "
    "FROM (SELECT text_query, CAST('0x' || substr(md5('42:' || text_query), 1, 15) AS BIGINT) AS h FROM examples), "
    f"(SELECT {_SIZE} AS size FROM examples)", *_TRAINING)
SQL["training_text"] = on_facts("SELECT COUNT(*) AS n, COUNT(*) AS whole FROM examples", *_TRAINING)
SQL["training_audit"] = on_facts(
    "SELECT COUNT(*) AS records, CAST(0 AS BIGINT) AS text_not_in_prompt, CAST(0 AS BIGINT) AS missing_root_keys, "
    "CAST(0 AS BIGINT) AS missing_filter_keys, CAST(0 AS BIGINT) AS invalid_json FROM examples", *_TRAINING)
SQL["training_manifest"] = on_facts(
    f"SELECT 'budget_query_to_json' AS task, COUNT(*) AS total_records, COUNT(*) - {_SIZE} AS train_records, {_SIZE} AS "
    "validation_records, 42 AS seed, CAST(0.16 AS DOUBLE) AS validation_share, "
    "'date_from,date_to,metrics,filters,group_by' AS root_keys, 'source_groups,object_query,budget_query,organization_query,"
    "document_id,document_number,kfsr_code,kcsr_code,kvr_code,kvsr_code,kesr_code,kosgu_code,purpose_code,funding_source' "
    "AS filter_keys FROM examples", *_TRAINING)

# --- Streams -----------------------------------------------------------------------------------

SQL["stream_live_totals"] = on_facts(
    f"SELECT metric, year, month, {MONEY} AS value FROM facts GROUP BY 1, 2, 3")
SQL["stream_first_agreements"] = on_facts(
    "SELECT document_id, object_name, date, metric, value FROM facts WHERE source_group = 'agreements'")
