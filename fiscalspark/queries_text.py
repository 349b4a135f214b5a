"""Registered queries for plain-language questions, training sets and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fiscalspark.functions import language as L
from fiscalspark.operators import distinct as D
from fiscalspark.plans import examples as X, questions as Q, resolve as R, training as G
from fiscalspark.queries import _facts, query
from fiscalspark.schema import TEXT_SEARCH_COLUMNS
from fiscalspark.session import ensure_checkpoint_dir
from fiscalspark.sources import mart
from fiscalspark.sources.mart import dealt, table
from fiscalspark.streaming import jobs


def _count() -> Column:
    return F.count(F.lit(1)).alias("n")

SUBJECT_WORDS = (
    "лимиты", "кассовые выплаты", "сумму соглашений", "договоры", "платежи", "обязательства без БО",
    "обязательства", "остаток лимитов", "данные", "ремонт дорогами", "территории школ", "Ёлки и дороги",
)
ENDINGS = ("", " по месяцам", " по годам", " по дням", " за 1997 год", " с 1996 по 1997 год", " за 1998г", " 2025, 2025")


def _pick(words: tuple[str, ...], key: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), (key % len(words)).cast("int"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per order: what is asked for, about which customer or nation, in which period."""
    orders = dealt(table(spark, sf_dir, "orders"), "o_orderkey").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    key = F.col("o_orderkey")
    nation = F.concat(F.lit("nation_"), F.col("c_nationkey"))
    about = F.when(key % 3 == 0, nation).when(key % 3 == 1, F.lower("c_mktsegment")).otherwise(F.lit("view"))
    text = F.concat(F.lit("Покажи "), _pick(SUBJECT_WORDS, key), F.lit(" по "), about, _pick(ENDINGS, key % 11))
    return orders.select(key.alias("query_id"), text.alias("text_query"))


@query("text_terms")
def text_terms(spark, sf_dir):
    """Search terms of whole documents, counted by document."""
    terms = dealt(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", L.search_terms(F.col("text")).alias("terms"))
    return terms.select(
        "doc_id", F.size("terms").cast("long").alias("n"), F.md5(F.array_join("terms", " ")).alias("digest"))


@query("question_terms")
def question_terms(spark, sf_dir):
    terms = F.array_join(L.search_terms(F.col("text_query")), " ").alias("terms")
    return questions(spark, sf_dir).groupBy(terms).agg(_count())


@query("text_stem")
def text_stem(spark, sf_dir):
    words = F.explode(F.regexp_extract_all(F.lower("text_query"), F.lit("([а-яё]+)"), 1))
    return questions(spark, sf_dir).select(words.alias("word")).groupBy(L.stem(F.col("word")).alias("stem")).agg(_count())


@query("infer_metric")
def infer_metric(spark, sf_dir):
    return questions(spark, sf_dir).groupBy(L.metric_hint(F.col("text_query")).alias("metric")).agg(_count())


@query("infer_metric_interp")
def infer_metric_interp(spark, sf_dir):
    both = F.concat(F.col("text_query"), F.when(F.col("query_id") % 2 == 0, " и расходы").otherwise(" и лимиты"))
    return questions(spark, sf_dir).groupBy(L.interpretation_metric_hint(both).alias("metric")).agg(_count())


@query("infer_group_by")
def infer_group_by(spark, sf_dir):
    return questions(spark, sf_dir).groupBy(L.group_by_hint(F.col("text_query")).alias("group_by")).agg(_count())


@query("infer_year_range")
def infer_year_range(spark, sf_dir):
    first, last = L.year_range(F.col("text_query"))
    return questions(spark, sf_dir).groupBy(first.alias("date_from"), last.alias("date_to")).agg(_count())


def _options(spark, sf_dir) -> DataFrame:
    """Every object, budget and organization of the facts."""
    facts = _facts(spark, sf_dir, "object_name", "budget_name", "organization_name")
    return D.catalogue(facts, ("object_name", "budget_name", "organization_name"))


@query("resolve_object_terms")
def resolve_object_terms(spark, sf_dir):
    return R.infer_objects(questions(spark, sf_dir), _options(spark, sf_dir))


def _asked(spark, sf_dir) -> DataFrame:
    """Questions with an interpretation that only names an organization, or nothing at all."""
    key = F.col("query_id")
    organization = F.when(key % 4 == 0, "NATION_1").when(key % 4 == 1, "supplier#00000000").when(key % 4 == 2, "лишнее")
    metrics = F.when(key % 5 == 0, F.array(F.lit("cash_payments")))
    grouping = F.when(key % 2 == 0, F.array(F.lit("month"))).otherwise(F.array(F.lit("object_name")))
    filters = F.struct(*[
        (organization if f == "organization_query" else F.lit(None)).cast(
            R.FILTERS_TYPE[f].dataType).alias(f) for f in R.FILTERS_TYPE.fieldNames()])
    patch = R.request(
        metrics=metrics, filters=filters, group_by=grouping, limit=F.when(key % 4 < 2, key % 1000 + 1), include_rows=F.when(key % 5 < 2, False))
    kvr = F.when(key % 7 == 0, "R")
    explicit = R.request(
        date_from=F.when(key % 6 == 0, F.lit("1996-01-01").cast("date")),
        metrics=F.when(key % 9 == 0, F.array(F.lit("limits"))),
        filters=F.struct(*[(kvr if f == "kvr_code" else F.lit(None)).cast(R.FILTERS_TYPE[f].dataType).alias(f)
                           for f in R.FILTERS_TYPE.fieldNames()]),
        group_by=F.when(key % 10 == 0, F.array(F.lit("year"))), limit=F.when(key % 3 == 0, 25), offset=F.when(key % 8 == 0, key),
        include_rows=F.when(key % 7 < 3, key % 2 == 0), include_charts=F.when(key % 11 == 0, False))
    return questions(spark, sf_dir).withColumn("explicit", explicit).withColumn("patch", patch)


@query("reclassify_org")
def reclassify_org(spark, sf_dir):
    done = R.complete(_asked(spark, sf_dir), _options(spark, sf_dir), R.known_metrics())
    return done.select(
        "query_id", F.array_join("patch.metrics", ",").alias("metrics"), F.array_join("patch.group_by", ",").alias("group_by"),
        F.col("patch.filters.organization_query").alias("organization_query"),
        F.col("patch.filters.object_query").alias("object_query"))


def _resolved(done: DataFrame, *more: str) -> DataFrame:
    wanted = ("organization_query", "kvr_code", "text_search")
    return done.select(
        "query_id", F.col("resolved.date_from").alias("date_from"), F.col("resolved.date_to").alias("date_to"),
        F.array_join("resolved.metrics", ",").alias("metrics"), F.array_join("resolved.group_by", ",").alias("group_by"),
        *[F.col(f"resolved.filters.{f}").alias(f) for f in wanted], *more)


@query("merge_request_patch")
def merge_request_patch(spark, sf_dir):
    return _resolved(R.merge(_asked(spark, sf_dir)))


@query("merge_page_fields")
def merge_page_fields(spark, sf_dir):
    """Page and parts of each resolved request: explicit values before those of the interpretation, before the defaults."""
    return R.resolve(_asked(spark, sf_dir)).select("query_id", *[F.col(f"resolved.{f}").alias(f) for f in R.PAGE_FIELDS])


@query("resolve_safety")
def resolve_safety(spark, sf_dir):
    return _resolved(R.resolve(_asked(spark, sf_dir)))


@query("resolve_no_interpretation")
def resolve_no_interpretation(spark, sf_dir):
    done = R.resolve(_asked(spark, sf_dir), unavailable=True)
    return _resolved(done, "interpreted", "warning")


def _replies(spark, sf_dir) -> DataFrame:
    """Model replies of varying tidiness, one per order."""
    key = F.col("o_orderkey")
    body = F.format_string(
        '{"metrics": %s, "filters": {"source_groups": "GZ", "document_id": [null, " %d "]}, "group_by": ["year", "x"]}',
        F.when(key % 3 == 0, '["Limits", "nope", "limits", "contract_amount"]').when(key % 3 == 1, '" LIMITS "')
        .otherwise("null"), key)
    reply = F.when(key % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(
        key % 4 == 1, F.concat(F.lit("Ответ: "), body, F.lit(" конец"))).when(key % 4 == 2, body).otherwise("нет {")
    return table(spark, sf_dir, "orders").select(key.alias("query_id"), F.lit("x").alias("text_query"), reply.alias("reply"))


@query("extract_reply_json")
def extract_reply_json(spark, sf_dir):
    return _replies(spark, sf_dir).select("query_id", R.reply_json(F.col("reply")).alias("json"))


@query("coerce_interpretation")
def coerce_interpretation(spark, sf_dir):
    patched = R.parse_replies(_replies(spark, sf_dir), R.known_metrics(), F.array(*[F.lit(g) for g in ("rchb", "gz")]))
    return patched.select(
        "query_id", F.array_join("patch.metrics", ",").alias("metrics"), F.array_join("patch.group_by", ",").alias("group_by"),
        F.array_join("patch.filters.source_groups", ",").alias("source_groups"),
        F.col("patch.filters.document_id").alias("document_id"))


@query("coerce_flags")
def coerce_flags(spark, sf_dir):
    key = F.col("o_orderkey")
    raw = F.when(key % 5 == 0, "true").when(key % 5 == 1, '"No"').when(key % 5 == 2, '"да"').when(key % 5 == 3, "0")
    new = F.when(key % 2 == 0, F.concat(F.lit(" "), F.col("o_orderpriority"))).otherwise("иное")
    changed = R.flag(F.try_parse_json(raw), F.col("o_orderpriority"), new)
    return table(spark, sf_dir, "orders").groupBy((key % 10).alias("bucket"), changed.alias("changed")).agg(_count())


@query("canonical_lists")
def canonical_lists(spark, sf_dir):
    """Source groups named in any spelling, brought to the spelling the facts use."""
    allowed = D.catalogue(_facts(spark, sf_dir, "source_group"), ("source_group",))
    listed = allowed.agg(F.array_sort(F.collect_list("value"))).scalar()
    key = F.col("o_orderkey")
    given = F.array(F.upper(F.lit("gz")), F.when(key % 2 == 0, " Rchb ").otherwise("нет"), F.lit("gz"))
    orders = table(spark, sf_dir, "orders").select(given.alias("given"), listed.alias("allowed"))
    spelled = F.array_join(R.canonical(F.col("given"), F.col("allowed")), ",")
    return orders.groupBy(spelled.alias("source_groups")).agg(_count())


_ANSWER_COLUMNS = (
    "year", "month", "object_name", "budget_name", "organization_name", "kfsr_code", "source_group", "date", "raw_data",
    *TEXT_SEARCH_COLUMNS)


@query("prepared_examples")
def prepared_examples(spark, sf_dir):
    facts = _facts(spark, sf_dir, "year", "month", "object_name", "budget_name", "kfsr_code", "source_group")
    return X.prepared(facts, mart.BATCH, X.for_mart())


def _subjects(spark, sf_dir) -> DataFrame:
    """One question per order about the customer's nation, a document code, a market segment or words; some by year."""
    orders = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    key = F.col("o_orderkey")
    text = F.concat(
        F.lit("Покажи "), _pick(("лимиты", "кассовые выплаты", "договоры"), key), F.when(key % 4 == 3, F.concat(
            F.lit(" "), F.lower("c_mktsegment"))).otherwise(""), F.lit(" за "), F.year("o_orderdate"), F.lit(" год"))
    subject = {"object_query": F.when(key % 4 == 0, F.col("n_name")), "kvr_code": F.when(key % 4 == 1, _pick(("A", "N", "R"), key % 7)),
               "funding_source": F.when(key % 4 == 2, F.col("c_mktsegment"))}
    filters = F.struct(*[subject.get(f, F.lit(None)).cast(R.FILTERS_TYPE[f].dataType).alias(f) for f in R.FILTERS_TYPE.fieldNames()])
    patch = R.request(filters=filters, group_by=F.when(key % 5 == 0, F.array(F.lit("year"))))
    return orders.select(
        key.alias("query_id"), text.alias("text_query"), F.lit(None).cast(R.REQUEST_TYPE).alias("explicit"), patch.alias("patch"))


@query("answer_questions")
def answer_questions(spark, sf_dir):
    """A question per order, resolved and answered over all facts; of each part of an answer its rows, months and total."""
    facts = _facts(spark, sf_dir, *_ANSWER_COLUMNS)
    found = Q.answer(R.resolve(_subjects(spark, sf_dir)), facts, mart.BATCH)
    return found.groupBy("query_id", "part").agg(
        _count(), F.sum("value").cast("decimal(38,2)").alias("total"), F.sum(F.col("year") * 12 + F.coalesce("month", F.lit(0))).alias("months"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce("period", "source_group"))), ",").alias("named"))


# --- Training sets -----------------------------------------------------------------------------


def _examples(spark, sf_dir) -> DataFrame:
    columns = ("object_name", "organization_name", "budget_name", "source_group", *G.CODE_LABELS)
    return G.examples(G.subjects(_facts(spark, sf_dir, *columns)))


@query("training_examples")
def training_examples(spark, sf_dir):
    target = F.col("target")
    subject = F.coalesce(target["filters"]["source_groups"][0], *[target["filters"][k] for k in G.FILTER_KEYS[1:]])
    return _examples(spark, sf_dir).select(
        "text_query", target["metrics"][0].alias("metric"), target["group_by"][0].alias("group_by"),
        target["date_from"].alias("date_from"), target["date_to"].alias("date_to"), subject.alias("subject"))


@query("training_records")
def training_records(spark, sf_dir):
    """Records whose answer, read back as JSON, says what the target says."""
    records = G.records(_examples(spark, sf_dir))
    metric = F.get_json_object("completion", "$.metrics[0]")
    return records.groupBy(metric.alias("metric"), F.get_json_object("completion", "$.group_by[0]").alias("group_by")).agg(
        _count(), F.count_if(F.contains("prompt", F.col("text_query"))).alias("with_text"))


@query("training_answers")
def training_answers(spark, sf_dir):
    """Whole texts: of every question, written by hand or made from the facts, its answer and the end of its prompt."""
    columns = ("object_name", "organization_name", "budget_name", "source_group", *G.CODE_LABELS)
    made = G.examples(G.subjects(_facts(spark, sf_dir, *columns)), G.curated(spark))
    records = G.training_text(G.records(made, instruction="?"))
    return records.select("text_query", "completion", "prompt", F.md5("text").alias("text_md5"))


@query("train_val_split")
def train_val_split(spark, sf_dir):
    """Which question is in which part."""
    return G.split(_examples(spark, sf_dir).select("text_query"))


@query("training_text")
def training_text(spark, sf_dir):
    texts = G.training_text(G.records(_examples(spark, sf_dir)))
    ends = F.endswith("text", F.col("completion")) & F.startswith("text", F.col("prompt"))
    return texts.agg(_count(), F.count_if(ends).alias("whole"))


@query("training_audit")
def training_audit(spark, sf_dir):
    return G.audit(G.records(_examples(spark, sf_dir)))


@query("training_manifest")
def training_manifest(spark, sf_dir):
    manifest = G.manifest(G.split(_examples(spark, sf_dir).select("text_query")))
    return manifest.drop("instruction").withColumns({k: F.array_join(k, ",") for k in ("root_keys", "filter_keys")})


@query("reply_is_json")
def reply_is_json(spark, sf_dir):
    valid = G.is_json(R.reply_json(F.col("reply")))
    return _replies(spark, sf_dir).groupBy(F.coalesce(valid, F.lit(False)).alias("valid")).agg(_count())


# --- Streams -----------------------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/fiscalspark/{name}-{uuid.uuid4()}"


def _stored_facts(spark: SparkSession, sf_dir: str, groups: tuple[str, ...]) -> str:
    path = _scratch(spark, "facts")
    mart.facts(spark, sf_dir, groups=groups).write.partitionBy("batch_id", "source_group").parquet(path)
    return path


@query("stream_live_totals")
def stream_live_totals(spark, sf_dir):
    facts = _stored_facts(spark, sf_dir, tuple(mart.GROUP_METRICS))
    out = _scratch(spark, "totals")
    stream = jobs.live_totals(jobs.fact_stream(spark, facts))
    jobs.write_totals(stream, out, _scratch(spark, "marks")).awaitTermination()
    return jobs.read_totals(spark, out)


@query("stream_first_agreements")
def stream_first_agreements(spark, sf_dir):
    """The same agreements arriving in two snapshots count once."""
    facts = _stored_facts(spark, sf_dir, ("agreements",))
    second = spark.read.parquet(facts).withColumn("source_file", F.lit("second"))
    second.write.mode("append").partitionBy("batch_id", "source_group").parquet(facts)
    out = _scratch(spark, "first")
    stream = jobs.first_agreements(jobs.fact_stream(spark, facts))
    jobs.write_first_agreements(stream, out, _scratch(spark, "marks")).awaitTermination()
    return spark.read.parquet(out).select("document_id", "object_name", "date", "metric", "value")
