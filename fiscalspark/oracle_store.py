"""SQL equivalents of the store, file and stream queries."""

from __future__ import annotations

from fiscalspark.oracle import MONEY, SQL, on_facts
from fiscalspark.oracle_import import _EVENT_ROWS, _EVENT_VALUES, _LINE_FACTS

SQL["batch_isolation"] = on_facts(
    f"SELECT 'tpch' AS batch_id, metric, {MONEY} AS value FROM facts GROUP BY metric UNION ALL "
    "SELECT 'second', metric, CAST(SUM(value * 2) AS DECIMAL(20,2)) FROM facts WHERE metric <> 'limits' GROUP BY metric")
SQL["store_round_trip"] = (
    "SELECT '3. ГЗ/Контракты ' || o_orderpriority || '.csv' AS source_file, o_orderkey AS row_number, 'К-' || o_orderkey "
    "AS con_number, CAST(o_orderdate AS DATE) AS con_date, CAST(o_totalprice AS DECIMAL(20,2)) AS con_amount, "
    "'К-' || o_orderkey AS raw_number FROM orders")
SQL["jsonl_round_trip"] = SQL["training_examples"]
SQL["report_files"] = SQL["report_object_summary"]
SQL["file_registry"] = (
    "SELECT kind, part, strlen(body) AS size_bytes, sha256(body) AS sha256, 'registered' AS status FROM ("
    "SELECT o_orderpriority AS kind, o_orderkey // 10000 AS part, string_agg(o_orderkey || ';' || o_custkey || chr(10), '' "
    "ORDER BY o_orderkey) AS body FROM orders GROUP BY 1, 2)")
SQL["ingest_messy_files"] = (
    "SELECT '1. РЧБ ' || ['июнь2025', 'июль2025', 'август2025'][l_orderkey % 4 + 1] AS file, '050' || l_linenumber AS "
    "kfsr_code, l_returnflag AS kvr_code, CAST(year(l_shipdate) AS INTEGER) AS year, metric, COUNT(*) AS n, "
    f"{MONEY} AS value FROM {_LINE_FACTS} WHERE value <> 0 AND l_orderkey % 4 < 3 GROUP BY ALL")
SQL["messy_file_profiles"] = (
    "SELECT folder, o_orderkey // 10000 AS part, source_group, 'processed' AS status, encoding, delimiter, "
    "CAST(before AS INTEGER) AS header_row_index, CAST(COUNT(*) AS INTEGER) AS rows_count, CAST(COUNT(*) AS INTEGER) AS raw_rows_imported, "
    "CAST(0 AS INTEGER) AS normalized_rows_imported FROM orders, (VALUES ('1. РЧБ июнь2025', 3, ';', 'utf-8-sig', 'rchb'), "
    "('1. РЧБ июль2025', 0, ',', 'utf-8-sig', 'rchb'), ('1. РЧБ август2025', 1, chr(9), 'cp1251', 'rchb'), "
    "('прочее', 0, ';', 'utf-8-sig', 'unknown')) AS f(folder, before, delimiter, encoding, source_group) GROUP BY ALL")
SQL["store_agreements"] = SQL["dedup_agreements"]
SQL["store_contract_lines"] = (
    "SELECT '3. ГЗ/Бюджетные строки.csv' AS source_file, l_orderkey * 10 + l_linenumber AS row_number, CAST(l_orderkey AS VARCHAR) AS "
    "con_document_id, '050' || l_linenumber AS kfsr_code, '01' || l_partkey AS kcsr_code, l_returnflag AS kvr_code, '225' AS kesr_code, "
    "'002' AS kvsr_code, CAST(NULL AS VARCHAR) AS purpose_code FROM lineitem")
SQL["store_payments"] = (
    "SELECT '3. ГЗ/Платежки.csv' AS source_file, o_orderkey AS row_number, CAST(o_orderkey AS VARCHAR) AS con_document_id, "
    "CAST(o_orderdate AS DATE) AS platezhka_paydate, 'key' || o_orderkey AS platezhka_key, '№ ' || o_orderkey AS platezhka_num, "
    "CASE WHEN o_orderstatus <> 'O' THEN CAST(o_totalprice AS DECIMAL(20,2)) END AS platezhka_amount FROM orders")
SQL["store_institution_payments"] = (
    "SELECT '4. Выгрузка БУАУ/' || event_type || '.csv' AS source_file, event_id AS row_number, 'Областной бюджет' AS budget_name, "
    "CAST(ts AS DATE) AS date, 'Организация ' || user_id AS organization_name, event_type AS grantor_name, '0702' AS kfsr_code, "
    "'011' AS kcsr_code, '611' AS kvr_code, '241' AS kosgu_code, json_extract_string(props, '$.k') AS subsidy_code, "
    + ", ".join(f"CAST({value} AS DECIMAL(20,2)) AS {name}" for name, value in zip(
        ("amount_with_refund", "amount_execution", "amount_recovery"), _EVENT_VALUES.values()))
    + f" FROM {_EVENT_ROWS}")
SQL["stream_import"] = (
    "SELECT CASE l_returnflag WHEN 'R' THEN 'arrivals-000001' ELSE 'arrivals-000000' END AS batch_id, l_returnflag AS "
    f"kvr_code, metric, COUNT(*) AS n, {MONEY} AS value, 'completed' AS status FROM {_LINE_FACTS} WHERE value <> 0 GROUP BY ALL")
