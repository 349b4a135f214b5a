import csv
import random
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fiscalspark.plans.ingest import ingest_archives, ingest_folder
from fiscalspark.sources import sinks, tree
from tests import exports as E

TREE = {
    "1. РЧБ/август2025.csv": b"\xef\xbb\xbf" + E.RCHB.encode("utf-8"),
    "1. РЧБ/июль2025.CSV": E.RCHB.replace("230 000,00;", "0,00;").encode("cp1251"),
    "2. Соглашения/на01022026.csv": E.agreements(E.agreement_row()),
    "2. Соглашения/на01032026.csv": E.agreements(E.agreement_row(), E.agreement_row(reg="new", close="")),
    "2. Соглашения/на99992025.csv": E.agreements(E.agreement_row(reg="other"), E.agreement_row(reg="x", close="")),
    "3. ГЗ/Контракты и договора.csv": E.CONTRACTS,
    "3. ГЗ/Бюджетные строки.csv": E.BUDGET_LINES,
    "3. ГЗ/Платежки.csv": E.PAYMENTS,
    "3. ГЗ/Контракты без номера.csv": E.CONTRACTS + ",К-2,2025-01-16,5.00,1401\n",
    "3. ГЗ/Платежки большие.csv": E.PAYMENTS.replace("198340.07", "1" + "0" * 18),
    "4. Выплаты БУАУ/сводка август 2025.csv": E.BUAU + ";;;;\n\nИтого;;;;;;;;;;;1,00;1,00;1,00\n",
    "прочее/a+b 100%.csv": "x;y\n1;2\n",
    "прочее/книга.xlsx": b"zz",
    "прочее/заметка.txt": b"zz",
}


@pytest.fixture(scope="module")
def imported(spark, tmp_path_factory):
    root = E.write(tmp_path_factory.mktemp("tree"), TREE)
    return ingest_folder(spark, root, "b1")


def _values(imported, path):
    rows = imported.facts.where(F.col("source_file") == path).select("metric", "value").collect()
    return {r["metric"]: r["value"] for r in rows}


def test_rchb_record_gives_five_facts(imported):
    assert _values(imported, "1. РЧБ/август2025.csv") == {
        "limits": Decimal("2345000.00"), "obligations": Decimal("1115000.00"),
        "obligations_without_bo": Decimal("230000.00"), "remaining_limits": Decimal("990000.00"),
        "cash_payments": Decimal("417000.00")}
    fact = imported.facts.where("source_file = '1. РЧБ/август2025.csv' and metric = 'limits'").first()
    assert fact["budget_name"] == fact["object_name"] == "Бюджет города Зеи"
    assert (fact["kfsr_code"], fact["kcsr_code"], fact["kesr_code"]) == ("0502", "0320161058", "241")
    assert (fact["year"], fact["month"], fact["row_number"]) == (2025, 8, 5)
    assert fact["organization_name"] == "Администрация города"
    assert fact["raw_data"]["Лимиты ПБС 2025 год"] == "2 345 000,00"


def test_zero_amounts_are_dropped_and_cp1251_is_read(imported):
    assert set(_values(imported, "1. РЧБ/июль2025.CSV")) == {
        "limits", "obligations", "remaining_limits", "cash_payments"}


def test_agreement_snapshots_count_once(imported):
    facts = imported.facts.where("metric = 'agreement_amount'").orderBy("document_number").collect()
    assert [(f["source_file"][-12:-4], f["document_number"], f["value"]) for f in facts] == [
        ("01022026", "A-17/204", Decimal("6450000.00")), ("01032026", "new", Decimal("6450000.00"))]
    assert str(facts[1]["date"]) == "2026-03-01"
    assert facts[0]["object_name"] == 'ГАУ "Родник"'
    assert imported.tables["agreements"].count() == 2


def test_contract_exports(imported):
    assert _values(imported, "3. ГЗ/Контракты и договора.csv") == {"contract_amount": Decimal("734105.25")}
    assert _values(imported, "3. ГЗ/Бюджетные строки.csv") == {}
    payment = imported.facts.where("metric = 'contract_payment'").first()
    assert payment["value"] == Decimal("198340.07") and payment["object_name"] is None
    line = imported.tables["contract_budget_lines"].first()
    assert (line["con_document_id"], line["kvsr_code"], line["purpose_code"]) == ("7300412", "002", "ОБ-1")
    assert imported.tables["contracts"].count() == 1 and imported.tables["payments"].count() == 1


def test_institution_payments(imported):
    path = "4. Выплаты БУАУ/сводка август 2025.csv"
    assert _values(imported, path) == {
        "institution_payments_with_refund": Decimal("5310428.64"),
        "institution_payments_execution": Decimal("5310428.64")}
    row = imported.tables["institution_payments"].first()
    assert row["amount_recovery"] == Decimal("0.00") and row["subsidy_code"] == "СУБ1"


def test_registry_and_batch(imported):
    registry = {r["relative_path"]: r for r in imported.registry.collect()}
    assert len(registry) == 13 and "прочее/заметка.txt" not in registry
    errors = {p: r["error_message"] for p, r in registry.items() if r["status"] == "error"}
    assert errors == {
        "2. Соглашения/на99992025.csv": "impossible date in the file name",
        "3. ГЗ/Контракты без номера.csv": "con_document_id is missing",
        "3. ГЗ/Платежки большие.csv": "amount does not fit DECIMAL(20,2)"}
    assert registry["прочее/книга.xlsx"]["status"] == "skipped"
    first = registry["1. РЧБ/август2025.csv"]
    assert (first["encoding"], first["delimiter"], first["header_row_index"]) == ("utf-8-sig", ";", 3)
    assert (first["rows_count"], first["raw_rows_imported"], first["normalized_rows_imported"]) == (1, 1, 5)
    assert registry["1. РЧБ/июль2025.CSV"]["encoding"] == "cp1251"
    assert len(first["sha256"]) == 64
    buau = registry["4. Выплаты БУАУ/сводка август 2025.csv"]
    assert (buau["rows_count"], buau["raw_rows_imported"], buau["normalized_rows_imported"]) == (4, 1, 3)
    assert registry["прочее/a+b 100%.csv"]["raw_rows_imported"] == 1
    batch = imported.batch.first()
    assert (batch["total_files"], batch["csv_files"], batch["error_count"]) == (14, 12, 3)
    assert batch["status"] == "completed_with_errors"
    assert imported.errors.count() == 3


def test_written_facts_come_back_by_batch(spark, imported, tmp_path):
    sinks.write_import(imported, str(tmp_path))
    facts = sinks.read_facts(spark, str(tmp_path), "b1")
    assert facts.count() == imported.facts.count() == 15
    assert sinks.read_facts(spark, str(tmp_path), "other").count() == 0
    assert "PartitionFilters: [isnotnull(batch_id" in facts._jdf.queryExecution().toString()


def _tricky_file(seed: int) -> str:
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        cells = [
            str(i), rng.choice(["простой текст", "с\nпереносом\nстрок", 'в "кавычках"', "а;б", ""]),
            rng.choice(["1 000,50", "x" * rng.randint(0, 60)]), "конец",
        ]
        line = ";".join('"' + c.replace('"', '""') + '"' if rng.random() < 0.7 or set(c) & set(';"\n') else c
                        for c in cells)
        rows.append(line)
        if rng.random() < 0.1:
            rows.append(rng.choice(["", 'ООО "Ромашка" 5" трубы;без пары;1;2']))
    return "Бюджет;Дата проводки;Сумма;Прочее\n" + "\n".join(rows) + "\n"


@pytest.mark.parametrize("block_bytes", [700, 5_000, 1 << 27])
def test_split_files_give_the_records_of_a_whole_read(spark, tmp_path, block_bytes):
    """Quoted line breaks across block borders, stray quotes and blank lines, at any block size."""
    files = {f"f{i}.csv": _tricky_file(i) for i in range(2)}
    root = E.write(tmp_path, files)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        lines = tree.read_lines(spark, root)
        blocks = tree.index_blocks(lines)
        records, problems = tree.read_records(tree.parse_blocks(lines, blocks), blocks)
        found = sorted((r["path"], r["row_number"], tuple(r["cells"])) for r in records.collect())
        n_blocks = blocks.count()
        assert problems.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = sorted(
        (name, i + 1, tuple(c.strip() for c in row))
        for name, text in files.items()
        for i, row in enumerate(csv.reader(text.splitlines(), delimiter=";")) if i > 0)
    assert found == expected
    assert n_blocks > 20 if block_bytes == 700 else n_blocks >= 2


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as archive:
        archive.writestr("1. РЧБ/январь2025.csv", E.RCHB)
        archive.writestr("readme.txt", "x")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as archive:
        archive.writestr("../evil.csv", "x")
        archive.writestr("1. РЧБ/ok.csv", E.RCHB)
    done = ingest_archives(spark, str(tmp_path), "z")
    assert {r["source_file"] for r in done.facts.select("source_file").distinct().collect()} == {
        "1. РЧБ/январь2025.csv"}
    assert done.facts.count() == 5
    assert [(e["path"], e["message"]) for e in done.errors.collect()] == [
        ("bad.zip", "unsafe archive path: ../evil.csv")]


def test_archives_with_equal_member_names_and_a_damaged_one(spark, tmp_path):
    name = "1. РЧБ/январь2025.csv"
    for archive in ("a.zip", "3. гз.zip"):
        with zipfile.ZipFile(tmp_path / archive, "w") as opened:
            opened.writestr(name, E.RCHB)
    with zipfile.ZipFile(tmp_path / "damaged.zip", "w") as opened:
        opened.writestr("1. РЧБ/whole.csv", E.RCHB)
        opened.writestr("1. РЧБ/broken.csv", E.RCHB + "mark-of-the-damage")
    raw = (tmp_path / "damaged.zip").read_bytes()
    (tmp_path / "damaged.zip").write_bytes(raw.replace(b"mark-of-the-damage", b"mark-of-the-DAMAGE"))
    done = ingest_archives(spark, str(tmp_path), "z")
    counts = {r["source_file"]: (r["source_group"], r["count"]) for r in done.facts.groupBy("source_file", "source_group").count().collect()}
    assert counts == {f"{archive}!/{name}": ("rchb", 5) for archive in ("a.zip", "3. гз.zip")}
    assert [e["path"] for e in done.errors.collect()] == ["damaged.zip"]


def test_header_rules(spark, tmp_path):
    """Duplicate and blank headers, short and long rows."""
    root = E.write(tmp_path, {
        "4. буау/dup.csv": "Бюджет;Дата проводки;Бюджет;;Выплаты - Исполнение 2025;Выплаты - Исполнение 2026\n"
                           "первый;01.01.2025;последний;x;;7,00;лишнее\nкороткий;02.01.2025\n"})
    done = ingest_folder(spark, root, "h", hash_files=False)
    rows = {r["row_number"]: r["data"] for r in done.raw_rows.collect()}
    assert rows[2] == {
        "Бюджет": "последний", "Дата проводки": "01.01.2025", "column_4": "x",
        "Выплаты - Исполнение 2025": "", "Выплаты - Исполнение 2026": "7,00"}
    assert rows[3]["Бюджет"] == "" and rows[3]["Дата проводки"] == "02.01.2025"
    # The first header containing the words counts, even though its cell is empty.
    assert done.facts.count() == 0
    assert done.tables["institution_payments"].where("row_number = 2").first()["budget_name"] == "последний"


def test_oversized_cell_fails_only_its_file(spark, tmp_path):
    """An unclosed quote swallows the rest of its file: longer than a cell may be, so the file fails."""
    root = E.write(tmp_path, {
        "1. рчб/bad.csv": E.RCHB + '"' + "\n".join("незакрытая кавычка" for _ in range(20_000)),
        "1. рчб/good.csv": E.RCHB})
    for block_bytes in (1 << 27, 200_000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", block_bytes)
        try:
            done = ingest_folder(spark, root, "o", hash_files=False)
            status = {r["relative_path"]: (r["status"], r["error_message"]) for r in done.registry.collect()}
            assert status["1. рчб/good.csv"] == ("processed", None)
            assert status["1. рчб/bad.csv"] == ("error", "field larger than field limit (131072)")
            assert done.facts.count() == 5
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_entries_broadcast_the_files_not_the_records(spark):
    """The per-file side is the small one; the records never go through the driver to every task."""
    from fiscalspark.operators import records as N
    from fiscalspark.sources import messy

    records, profiles = messy.agreements(spark, "/root/testdata/sf0.001")
    entry = N.entries(records, N.place_columns(profiles))
    assert entry.count() == 300
    plan = entry._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert joins and all("BuildRight" in line for line in joins), plan
