import json

from pyspark.sql import functions as F

from fiscalspark.plans import training as G
from fiscalspark.sources import sinks

SUBJECTS = [
    ("object_query", "Благовещенску", "Благовещенск"), ("object_query", "Тынде", "Тында"),
    ("organization_query", 'ГАУ "Родник"', 'ГАУ "Родник"'), ("budget_query", "бюджету г. Тынды", "Бюджет г. Тынды"),
    ("source_groups", "gz", "gz"), ("source_groups", "rchb", "rchb"), ("kfsr_code", "0502", "0502"),
    ("funding_source", "Региональные средства", "Региональные средства"),
]


def _examples(spark, curated=None):
    return G.examples(spark.createDataFrame(SUBJECTS, "kind string, text string, canonical string"), curated)


def test_expansion(spark):
    rows = {r["text_query"]: r["target"] for r in _examples(spark).collect()}
    per_object, per_code = 8 * 4 * 3 + 4 * 3, 3 * 2 + 2 * 2
    assert len(rows) == 2 * per_object + 8 * 2 + 8 + (2 + 5) * 2 + per_code
    # (12 letters + 6) % 3 phrases -> the first one
    assert rows["Покажи лимиты по Благовещенску по месяцам"]["group_by"] == ["month"]
    assert rows["Покажи лимиты по Благовещенску по месяцам"]["filters"]["object_query"] == "Благовещенск"
    assert rows["Покажи сумму контрактов по источнику gz"]["filters"]["source_groups"] == ["gz"]
    assert rows["Покажи платежи по контрактам из gz по месяцам"]["metrics"] == ["contract_payment"]
    assert rows["Покажи обязательства по КФСР 0502 по годам"]["filters"]["kfsr_code"] == "0502"
    dated = rows["Покажи лимиты по Тынде с 10.02.2025 по 01.05.2026"]
    assert (dated["date_from"], dated["date_to"], dated["group_by"]) == ("2025-02-10", "2026-05-01", None)


def test_later_answer_of_an_equal_text_stays(spark):
    text = "Покажи лимиты по КФСР 0502"
    target = F.struct(*[F.lit(None).alias(n) for n in G.TARGET_TYPE.fieldNames()])
    curated = spark.createDataFrame([(text,), ("своё",)], "text_query string").withColumn("target", target)
    rows = {r["text_query"]: r["target"] for r in _examples(spark, curated).collect()}
    assert rows[text]["metrics"] == ["limits"] and rows["своё"]["metrics"] is None


def test_records_read_back_and_completion_is_indented_json(spark, tmp_path):
    records = G.records(_examples(spark))
    for row in records.limit(40).collect():
        target = row["target"].asDict(recursive=True)
        assert row["completion"] == json.dumps(target, ensure_ascii=False, indent=2)
        assert row["text_query"] in row["prompt"]
    sinks.write_jsonl(records, str(tmp_path / "set"))
    back = G.read_records(spark, str(tmp_path / "set"))
    assert back.schema == G.RECORD_TYPE and back.count() == records.count()
    assert back.exceptAll(records).count() == 0
    audit = G.audit(records).first().asDict()
    assert audit.pop("records") == records.count() and set(audit.values()) == {0}


def test_split_is_exact_and_repeatable(spark):
    records = G.records(_examples(spark))
    n = records.count()
    first = {r["text_query"] for r in G.split(records).where("split = 'validation'").collect()}
    again = {r["text_query"] for r in G.split(records.repartition(7)).where("split = 'validation'").collect()}
    other = {r["text_query"] for r in G.split(records, seed=7).where("split = 'validation'").collect()}
    assert len(first) == max(12, int(n * 0.16)) and first == again and first != other
    assert G.split(records).count() == n
    manifest = G.manifest(G.split(records)).first()
    assert (manifest["total_records"], manifest["validation_records"]) == (n, len(first))


def test_replies(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("{",), ("",)], "t string")
    assert [r[0] for r in df.select(G.is_json(F.col("t"))).collect()] == [True, False, False]
