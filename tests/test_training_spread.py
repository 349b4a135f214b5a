"""Training questions are compared only where two may be equal, and only records at the border of a split are ranked."""

import gzip

from pyspark.sql import functions as F

from fiscalspark.operators.distinct import catalogue
from fiscalspark.plans import training as G
from fiscalspark.sources import sinks

KINDS = ("object_query", "organization_query", "budget_query", "kfsr_code", "kvr_code")
NAMES = (
    "Тында", "организации Тында", "Тында по месяцам", "по КФСР 7 по годам", "КФСР 7", "7", "по", "", " ", " Тында", "Тында ",
    "бюджет  края", "по организации по организации Тында", "месяцам", "Школа по делам", "финансирования по Тында", "Тында с 01.01.2025",
)


def _subjects(spark):
    rows = [(k, n, c) for k in KINDS for n in NAMES for c in dict.fromkeys((n, n.strip()))]
    rows += [("object_query", None, "x"), ("object_query", "y", None), ("source_groups", "gz", "gz"), (None, "z", "z"), ("budget_query", "Тында", "Тында")]
    return spark.createDataFrame(rows, "kind string, text string, canonical string")


def _plain(spark, subject, curated=None):
    """The last answer of every text, found by comparing all questions."""
    template = F.col("t")
    place = F.struct(F.lit(1).alias("section"), "kind", F.col("canonical").alias("subject"), template["place"].alias("place"))
    every = subject.withColumn("t", F.explode(G._templates())).select(
        G._question(template).alias("text_query"), place.alias("position"), G._target(template).alias("target"))
    if curated is not None:
        first = F.struct(F.lit(0).alias("section"), F.lit("").alias("kind"), F.col("text_query").alias("subject"), F.lit(0).alias("place"))
        every = every.unionByName(curated.select("text_query", first.alias("position"), "target"))
    best: dict = {}
    for r in every.collect():
        rank = tuple((v is not None, v) for v in r["position"])
        low, high = best.setdefault(r["text_query"], [(rank, r["position"]), (rank, r["target"])])
        best[r["text_query"]] = [min((rank, r["position"]), low, key=lambda x: x[0]), max((rank, r["target"]), high, key=lambda x: x[0])]
    return {text: (low[1], high[1]) for text, (low, high) in best.items()}


def _found(df):
    rows = df.collect()
    found = {r["text_query"]: (r["position"], r["target"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_last_answers_of_names_that_hold_template_words(spark):
    subject = _subjects(spark)
    curated = G.curated(spark, (*G.CURATED, ("Покажи лимиты по Школа по делам", ("limits",), None, {}), ("", None, None, {})))
    assert _found(G.examples(subject)) == _plain(spark, subject)
    assert _found(G.examples(subject, curated)) == _plain(spark, subject, curated)


def test_questions_about_names_of_their_own_are_not_shuffled(spark):
    subject = spark.createDataFrame([("object_query", "Тында", "Тында")], "kind string, text string, canonical string")
    plan = G.examples(subject)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")  # before, every question went through one aggregate by its text
    marked = G._marked(_subjects(spark), None).where("text = 'Школа по делам' and kind in ('object_query', 'budget_query')")
    assert [r["apart"] for r in marked.collect()] == [False, False]  # both ask "Покажи … по Школа по делам"
    only = G._marked(subject.unionByName(subject.withColumn("kind", F.lit("organization_query"))), None)
    assert [r["apart"] for r in only.collect()] == [True, True]


def test_only_the_range_at_the_border_is_ranked(spark):
    texts = spark.range(3000).select(F.concat(F.lit("q"), F.col("id") % 2500).alias("text_query"))  # some texts twice
    done = G.split(texts)
    assert done.count() == 3000 and done.where("split = 'validation'").count() == 480
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")  # before, every record was shuffled and sorted
    hashed = done.select("split", G.split_hash(F.col("text_query"), G.SEED).alias("h"))
    last, first = (hashed.where(F.col("split") == s).agg(f("h")).first()[0] for s, f in (("validation", F.max), ("train", F.min)))
    assert last <= first


def test_catalogue_holds_each_value_once(spark):
    facts = spark.createDataFrame([("a", "x"), ("a", None), ("", "y"), (None, "x")], "object_name string, budget_name string")
    found = sorted(tuple(r) for r in catalogue(facts, ("object_name", "budget_name")).collect())
    assert found == [("budgets", "x"), ("budgets", "y"), ("objects", "a")]


def test_names_are_dealt_over_all_tasks(spark):
    subject = spark.createDataFrame([("object_query", f"Школа {i}", f"Школа {i}") for i in range(50)], "kind string, text string, canonical string")
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = G.examples(subject).select(F.spark_partition_id().alias("task"))
    assert wanted > 1 and made.distinct().count() == wanted  # adaptive execution would put these few bytes into one task


def test_written_records_are_compressed(spark, tmp_path):
    records = G.records(G.examples(spark.createDataFrame([("object_query", "Тында", "Тында")], "kind string, text string, canonical string")))
    sinks.write_jsonl(records, str(tmp_path / "set"))
    files = list((tmp_path / "set").glob("part-*"))
    plain = sum(len(line) for f in files for line in gzip.open(f))
    assert sum(f.stat().st_size for f in files) * 5 < plain
    assert G.read_records(spark, str(tmp_path / "set")).exceptAll(records).count() == 0
