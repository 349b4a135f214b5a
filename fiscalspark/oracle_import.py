"""SQL equivalents of the import queries: what clean values the messy inputs stand for."""

from __future__ import annotations

from fiscalspark.oracle import SQL

N = "COUNT(*) AS n"

SQL["norm_clean_text"] = (
    f"SELECT CASE WHEN o_orderkey % 4 <> 1 THEN o_orderpriority END AS cleaned, {N} FROM orders GROUP BY 1")
SQL["norm_header"] = (
    "SELECT 'елка' || replace(lower(p_name), ' ', '') || 'побо' || p_size || 'год' AS header, "
    f"{N} FROM part GROUP BY 1")
SQL["norm_code"] = (
    f"SELECT CASE WHEN l_linenumber <> 1 THEN '032' || l_partkey END AS code, {N} FROM lineitem GROUP BY 1")
SQL["norm_search_text"] = (
    f"SELECT 'еж ' || lower(c_mktsegment) || ' ее' AS text, {N} FROM customer GROUP BY 1")
SQL["parse_amount"] = (
    f"SELECT l_returnflag, COUNT(v) AS parsed, {N}, CAST(SUM(v) AS DECIMAL(20,2)) AS value FROM (SELECT l_returnflag, "
    "CASE WHEN l_orderkey % 11 = 3 THEN -p WHEN l_orderkey % 11 > 3 THEN p END AS v FROM (SELECT *, "
    "CAST(l_extendedprice AS DECIMAL(20,2)) AS p FROM lineitem)) GROUP BY 1")
SQL["parse_amount_half_even"] = (
    "SELECT o_orderkey % 100 AS bucket, CAST(SUM((o_orderkey + [0.00, 0.02, 0.12, 0.14, 1.00][o_orderkey % 5 + 1]::DECIMAL(20,2)) "
    "* CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) AS DECIMAL(20,2)) AS value FROM orders GROUP BY 1")
SQL["parse_date"] = (
    f"SELECT CASE WHEN l_orderkey % 97 > 1 THEN CAST(l_shipdate AS DATE) END AS day, {N} FROM lineitem GROUP BY 1")
_DATED = "CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END"
SQL["date_parts"] = (
    f"SELECT CAST(year({_DATED}) AS INTEGER) AS year, CAST(month({_DATED}) AS INTEGER) AS month, {N} "
    "FROM orders GROUP BY 1, 2")
SQL["period_label"] = (
    "SELECT CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, "
    f"'%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE '— — —' END AS period, {N} FROM orders GROUP BY 1")
SQL["path_source_group"] = (
    "SELECT CASE o_orderkey % 10 WHEN 0 THEN 'rchb' WHEN 1 THEN 'rchb' WHEN 2 THEN 'agreements' WHEN 3 THEN "
    "'agreements' WHEN 4 THEN 'gz' WHEN 5 THEN 'gz' WHEN 6 THEN 'buau' WHEN 7 THEN 'buau' WHEN 8 THEN "
    f"'control_example' ELSE 'unknown' END AS source_group, {N} FROM orders GROUP BY 1")
SQL["path_period"] = (
    "SELECT CASE event_id % 3 WHEN 0 THEN CAST(ts AS DATE) WHEN 1 THEN CAST(date_trunc('month', ts) AS DATE) END "
    f"AS period, event_id % 3 = 2 AS impossible, {N} FROM events GROUP BY 1, 2")
SQL["file_admission"] = (
    "SELECT * FROM (SELECT CASE o_orderkey % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.xls' WHEN 3 THEN "
    "'.pdf' END AS extension, CASE WHEN o_orderkey % 6 = 0 THEN 'registered' ELSE 'skipped' END AS status, "
    "CASE WHEN o_orderkey % 6 > 0 THEN 'Only CSV files are parsed at this stage; file was registered only.' END "
    f"AS error_message, {N} FROM orders GROUP BY 1, 2, 3) WHERE extension IS NOT NULL")

# --- Records -> facts and typed tables ---------------------------------------------------------

_PRICE = "CAST(l_extendedprice AS DECIMAL(20,2))"
_LINE_VALUES = {
    "limits": _PRICE,
    "obligations": f"ROUND({_PRICE} * (1 - CAST(l_discount AS DECIMAL(20,2))), 2)",
    "obligations_without_bo": f"ROUND({_PRICE} * CAST(l_discount AS DECIMAL(20,2)), 2)",
    "remaining_limits": f"ROUND({_PRICE} * CAST(l_tax AS DECIMAL(20,2)), 2)",
    "cash_payments": f"CASE WHEN l_linestatus = 'F' THEN ROUND({_PRICE} * (1 - CAST(l_discount AS DECIMAL(20,2))), 2) END",
}
_LINE_FACTS = "(" + " UNION ALL ".join(
    f"SELECT *, '{metric}' AS metric, CAST({value} AS DECIMAL(20,2)) AS value FROM lineitem"
    for metric, value in _LINE_VALUES.items()) + ")"
_MONEY = "CAST(SUM(value) AS DECIMAL(20,2)) AS value"
SQL["unpivot_rchb"] = (
    "SELECT '1. РЧБ/' || l_returnflag || '.csv' AS source_file, 'Орган ' || l_linestatus AS organization_name, "
    "'050' || l_linenumber AS kfsr_code, l_returnflag AS kvr_code, '002' AS kvsr_code, '241' AS kesr_code, "
    "'241' AS kosgu_code, CAST(NULL AS VARCHAR) AS purpose_code, 'Региональные средства' AS funding_source, "
    "CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, metric, "
    f"{N}, {_MONEY}, CAST(SUM(length('Бюджет ' || l_suppkey)) AS BIGINT) AS object_letters, "
    f"CAST(SUM(length('032' || l_partkey)) AS BIGINT) AS kcsr_letters FROM {_LINE_FACTS} WHERE value <> 0 "
    "GROUP BY ALL")
SQL["raw_rows_rchb"] = (
    "SELECT '1. РЧБ/' || l_returnflag || '.csv' AS source_file, '05.0' || l_linenumber AS kfsr, 15 AS width, "
    f"{N} FROM lineitem GROUP BY ALL")
SQL["ingest_files"] = (
    "SELECT '050' || l_linenumber AS kfsr_code, l_returnflag AS kvr_code, CAST(year(l_shipdate) AS INTEGER) AS year, "
    f"metric, {N}, {_MONEY} FROM {_LINE_FACTS} WHERE value <> 0 GROUP BY ALL")

_SNAPSHOTS = (
    "(SELECT *, CASE WHEN c_custkey % 10 <> 0 THEN DATE '1998-01-01' + CAST(c_custkey % 700 AS INTEGER) ELSE snap_date "
    "END AS closed, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS recipient, CAST(c_acctbal AS DECIMAL(20,2)) AS "
    "amount FROM customer, (VALUES ('на01022026', DATE '2026-02-01'), ('на01032026', DATE '2026-03-01')) "
    "AS s(snap, snap_date))"
)
_FIRST_SNAPSHOT = "(c_custkey % 10 = 0 OR snap = 'на01022026')"
_AGREEMENT_FILE = "'2. Соглашения/' || snap || '.csv'"
SQL["agreement_facts"] = (
    f"SELECT {_AGREEMENT_FILE} AS source_file, c_custkey AS row_number, 'Областной бюджет' AS budget_name, "
    "coalesce(recipient, 'Областной бюджет') AS object_name, recipient AS organization_name, 'R-' || c_custkey AS "
    "document_number, CAST(c_custkey AS VARCHAR) AS document_id, closed AS date, '0407' AS kfsr_code, "
    "CAST(c_nationkey AS VARCHAR) AS kcsr_code, '611' AS kvr_code, c_mktsegment AS purpose_code, "
    f"'agreement_amount' AS metric, amount AS value FROM {_SNAPSHOTS} WHERE amount <> 0")
SQL["dedup_agreement_facts"] = (
    f"SELECT {_AGREEMENT_FILE} AS source_file, c_custkey AS row_number, CAST(c_custkey AS VARCHAR) AS document_id, "
    "closed AS date, coalesce(recipient, 'Областной бюджет') AS object_name, 'agreement_amount' AS metric, "
    f"amount AS value FROM {_SNAPSHOTS} WHERE amount <> 0 AND {_FIRST_SNAPSHOT}")
SQL["dedup_agreements"] = (
    f"SELECT {_AGREEMENT_FILE} AS source_file, c_custkey AS row_number, CAST(c_custkey AS VARCHAR) AS document_id, "
    "'R-' || c_custkey AS reg_number, closed AS close_date, 'Областной бюджет' AS budget_name, recipient AS "
    "recipient_name, amount AS amount_1year, '0407' AS kfsr_code, CAST(c_nationkey AS VARCHAR) AS kcsr_code, "
    f"'611' AS kvr_code, c_mktsegment AS purpose_code FROM {_SNAPSHOTS} WHERE {_FIRST_SNAPSHOT}")
SQL["contract_facts"] = (
    "SELECT '3. ГЗ/Контракты ' || o_orderpriority || '.csv' AS source_file, o_orderkey AS row_number, "
    "CAST(o_custkey AS VARCHAR) AS object_name, CAST(o_custkey AS VARCHAR) AS organization_name, 'К-' || o_orderkey "
    "AS document_number, CASE WHEN o_orderpriority <> '5-LOW' OR o_orderkey % 100 <> 0 THEN CAST(o_orderkey AS VARCHAR) "
    "END AS document_id, CAST(o_orderdate AS DATE) AS date, 'contract_amount' AS metric, "
    "CAST(o_totalprice AS DECIMAL(20,2)) AS value FROM orders WHERE o_totalprice <> 0")
SQL["contract_budget_lines"] = (
    "SELECT '050' || l_linenumber AS kfsr_code, '01' || l_partkey AS kcsr_code, l_returnflag AS kvr_code, '225' AS "
    "kesr_code, '002' AS kvsr_code, CAST(NULL AS VARCHAR) AS purpose_code, COUNT(*) AS n, "
    "MIN(CAST(l_orderkey AS VARCHAR)) AS first_document FROM lineitem GROUP BY ALL")
SQL["payment_facts"] = (
    "SELECT '3. ГЗ/Платежки.csv' AS source_file, o_orderkey AS row_number, CAST(NULL AS VARCHAR) AS object_name, "
    "'№ ' || o_orderkey AS document_number, CAST(o_orderkey AS VARCHAR) AS document_id, CAST(o_orderdate AS DATE) AS "
    "date, 'contract_payment' AS metric, CAST(o_totalprice AS DECIMAL(20,2)) AS value FROM orders "
    "WHERE o_orderstatus <> 'O'")
_EVENT_VALUES = {
    "institution_payments_with_refund": "CAST(value AS DECIMAL(20,2))",
    "institution_payments_execution": "CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(20,2)) ELSE 0 END",
    "institution_payments_recovery": "CASE WHEN event_type = 'error' THEN CAST(value AS DECIMAL(20,2)) END",
}
_EVENT_ROWS = "(SELECT * FROM events WHERE event_id % 50 > 1)"
SQL["unpivot_buau"] = (
    "SELECT source_file, 'Областной бюджет' AS object_name, organization_name, '0702' AS kfsr_code, purpose_code, "
    f"metric, {N}, {_MONEY} FROM (" + " UNION ALL ".join(
        "SELECT '4. Выгрузка БУАУ/' || event_type || '.csv' AS source_file, 'Организация ' || user_id AS "
        "organization_name, json_extract_string(props, '$.k') AS purpose_code, "
        f"'{metric}' AS metric, CAST({value} AS DECIMAL(20,2)) AS value FROM {_EVENT_ROWS}"
        for metric, value in _EVENT_VALUES.items())
    + ") WHERE value <> 0 GROUP BY ALL")
SQL["institution_payments"] = (
    "SELECT 'Областной бюджет' AS budget_name, event_type AS grantor_name, '011' AS kcsr_code, '241' AS kosgu_code, "
    f"{N}, " + ", ".join(
        f"CAST(SUM({value}) AS DECIMAL(20,2)) AS {name}" for name, value in zip(
            ("amount_with_refund", "amount_execution", "amount_recovery"), _EVENT_VALUES.values()))
    + f" FROM {_EVENT_ROWS} GROUP BY event_type")
SQL["dedup_last_wins"] = (
    "SELECT o_custkey, MIN(o_orderkey) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority "
    "FROM orders GROUP BY 1")
_CONTRACT_FILES = (
    "(SELECT '3. ГЗ/Контракты ' || o_orderpriority || '.csv' AS path, COUNT(*) AS n, "
    "COUNT(*) FILTER (WHERE o_totalprice <> 0) AS facts, "
    "COUNT(*) FILTER (WHERE o_orderpriority = '5-LOW' AND o_orderkey % 100 = 0) AS bad FROM orders GROUP BY 1)"
)
SQL["file_quarantine"] = (
    "SELECT path, CASE WHEN bad = 0 THEN n ELSE 0 END AS contracts, CASE WHEN bad > 0 THEN 'con_document_id is missing' "
    f"END AS message FROM {_CONTRACT_FILES}")

_COUNTS = " UNION ALL ".join([
    "SELECT '1. РЧБ/' || l_returnflag || '.csv' AS path, FALSE AS failed, COUNT(DISTINCT rowid_) AS seen, "
    "COUNT(DISTINCT rowid_) AS kept, COUNT(*) FILTER (WHERE value <> 0) AS normalized FROM "
    + _LINE_FACTS.replace("FROM lineitem", "FROM (SELECT *, row_number() OVER () AS rowid_ FROM lineitem)")
    + " GROUP BY 1",
    f"SELECT {_AGREEMENT_FILE}, FALSE, COUNT(*), COUNT(*), COUNT(*) FILTER (WHERE {_FIRST_SNAPSHOT}) + "
    f"COUNT(*) FILTER (WHERE {_FIRST_SNAPSHOT} AND amount <> 0) FROM {_SNAPSHOTS} GROUP BY 1",
    f"SELECT path, bad > 0, n, n, n + facts FROM {_CONTRACT_FILES}",
    "SELECT '3. ГЗ/Бюджетные строки.csv', FALSE, COUNT(*), COUNT(*), COUNT(*) FROM lineitem",
    "SELECT '3. ГЗ/Платежки.csv', FALSE, COUNT(*), COUNT(*), COUNT(*) + COUNT(*) FILTER (WHERE o_orderstatus <> 'O') "
    "FROM orders",
    "SELECT '4. Выгрузка БУАУ/' || event_type || '.csv', FALSE, COUNT(*), COUNT(*) FILTER (WHERE event_id % 50 > 1), "
    "COUNT(*) FILTER (WHERE event_id % 50 > 1) + " + " + ".join(
        f"COUNT(*) FILTER (WHERE event_id % 50 > 1 AND {value} <> 0)" for value in _EVENT_VALUES.values())
    + " FROM events GROUP BY 1",
])
_REGISTRY = (
    f"(SELECT path, failed, CASE WHEN failed THEN 0 ELSE seen END AS seen, CASE WHEN failed THEN 0 ELSE kept END AS kept, "
    f"CASE WHEN failed THEN 0 ELSE normalized END AS normalized FROM ({_COUNTS}))"
)
SQL["file_counts"] = (
    "SELECT path AS relative_path, CASE WHEN failed THEN 'error' ELSE 'processed' END AS status, seen AS rows_count, "
    f"kept AS raw_rows_imported, normalized AS normalized_rows_imported FROM {_REGISTRY}")
SQL["batch_rollup"] = (
    "SELECT 'tpch' AS batch_id, COUNT(*) + (SELECT COUNT(*) FROM nation) AS total_files, COUNT(*) AS csv_files, "
    "CAST(SUM(kept) AS BIGINT) AS raw_rows_imported, CAST(SUM(normalized) AS BIGINT) AS normalized_rows_imported, "
    "COUNT(*) FILTER (WHERE failed) AS error_count, CASE WHEN bool_or(failed) THEN 'completed_with_errors' ELSE "
    "'completed' END AS status, 'Imported ' || SUM(kept) || ' raw rows and ' || SUM(normalized) || "
    f"' normalized rows from ' || COUNT(*) || ' CSV files.' AS message FROM {_REGISTRY}")
SQL["files_listing"] = (
    "SELECT path AS relative_path, split_part(path, '/', -1) AS original_name, '.csv' AS extension, CASE path[1:1] "
    "WHEN '1' THEN 'rchb' WHEN '2' THEN 'agreements' WHEN '3' THEN 'gz' ELSE 'buau' END AS source_group, "
    f"CASE WHEN failed THEN 'error' ELSE 'processed' END AS status FROM {_REGISTRY} UNION ALL "
    "SELECT 'прочее/' || n_name || '.pdf', n_name || '.pdf', '.pdf', 'unknown', 'skipped' FROM nation "
    "WHERE n_nationkey % 2 = 0")
SQL["errors_listing"] = (
    "SELECT batch_id, path, 'error' AS level, 'con_document_id is missing' AS message, path AS context_path, created_on "
    f"FROM {_CONTRACT_FILES}, (VALUES ('first', DATE '2026-01-01'), ('second', DATE '2026-02-01')) AS b(batch_id, created_on) WHERE bad > 0")
SQL["latest_batch"] = (
    "SELECT o_orderpriority AS input_type, o_custkey AS original_name, CAST(o_orderdate AS DATE) AS created_at, "
    "o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderpriority, "
    "o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1")
