"""Registered queries that write a store, files or a landing folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from fiscalspark.operators import aggregates as A, quarantine as Q, records as N, report as R
from fiscalspark.operators.filters import matching
from fiscalspark.plans import training as G
from fiscalspark.plans.ingest import ingest_folder, materialize
from fiscalspark.plans.request import Request
from fiscalspark.queries import _report, query
from fiscalspark.queries_text import _examples
from fiscalspark.session import ensure_checkpoint_dir
from fiscalspark.sources import mart, messy, sinks, tree
from fiscalspark.sources.mart import dealt, table
from fiscalspark.streaming import jobs


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that is deleted when the session's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fiscalspark/{name}-{uuid.uuid4()}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


@query("batch_isolation")
def batch_isolation(spark, sf_dir):
    """Two batches in one store; each is read through its own partition folders and summed."""
    store = _folder(spark, "store")
    facts = mart.facts(spark, sf_dir)
    sinks.write_facts(facts, store)
    doubled = facts.withColumns({"batch_id": F.lit("second"), "value": (F.col("value") * 2).cast("decimal(20,2)")})
    sinks.write_facts(doubled.where("metric <> 'limits'"), store)
    parts = [
        A.summary(matching(sinks.read_facts(spark, store, batch), Request(batch))).select(
            F.lit(batch).alias("batch_id"), "metric", "value") for batch in (mart.BATCH, "second")]
    return parts[0].unionByName(parts[1])


@query("store_round_trip")
def store_round_trip(spark, sf_dir):
    """Contracts of two batches through the typed and the raw table; one batch replaced by itself, the other left out."""
    store = _folder(spark, "store")
    records, profiles = messy.contracts(spark, sf_dir)
    # Records are dealt over all tasks and the entries kept, so the six writes normalise them once.
    entries = materialize(N.entries(dealt(records, "row_number"), N.place_columns(profiles)), "entries")
    for batch, replace in (("one", False), ("two", False), ("one", True)):
        for name, df in (("contracts", N.typed(entries, "contracts")), ("raw_rows", N.raw_rows(entries))):
            sinks.append(df.select(F.lit(batch).alias("batch_id"), "*"), f"{store}/{name}", "batch_id", replace=replace)
    entries.unpersist()
    contracts, raw = (spark.read.parquet(f"{store}/{name}").where("batch_id = 'one'") for name in ("contracts", "raw_rows"))
    number = F.col("data")["con_number"].alias("raw_number")
    return contracts.select("source_file", "row_number", "con_number", "con_date", "con_amount").join(
        raw.select("source_file", "row_number", number), ["source_file", "row_number"])


@query("jsonl_round_trip")
def jsonl_round_trip(spark, sf_dir):
    """Training records written as JSON lines and read back under the explicit schema."""
    path = _folder(spark, "records")
    sinks.write_jsonl(G.records(_examples(spark, sf_dir)), path)
    back = G.read_records(spark, path)
    target = F.col("target")
    subject = F.coalesce(target["filters"]["source_groups"][0], *[target["filters"][k] for k in G.FILTER_KEYS[1:]])
    return back.where(F.contains("prompt", F.col("text_query"))).select(
        "text_query", F.get_json_object("completion", "$.metrics[0]").alias("metric"), target["group_by"][0].alias("group_by"),
        target["date_from"].alias("date_from"), target["date_to"].alias("date_to"), subject.alias("subject"))


@query("report_files")
def report_files(spark, sf_dir):
    """The five sheets written as CSV under readers' titles; the pivoted one is read back."""
    target, report = _folder(spark, "report"), _report(spark, sf_dir)
    sinks.write_report(report.sheets(titles=True), target, "csv")
    sheet, plain = R.SHEETS[1], R.object_summary(report.rows, report.request)
    back = spark.read.option("header", "true").csv(f"{target}/{sheet}").select(
        *[f"`{title}`" for title in R.titled(plain).columns]).toDF(*plain.columns)
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in plain.schema])


#: Keys whose rows go into one written file, so files stay alike in size and their number grows with the tables.
KEYS_PER_FILE = 10_000


@query("file_registry")
def file_registry(spark, sf_dir):
    """Files written from orders, one per priority and range of keys, listed with size and streamed digest."""
    root = _folder(spark, "files")
    lines = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("kind"), F.floor(F.col("o_orderkey") / KEYS_PER_FILE).alias("part"), "o_orderkey",
        F.concat_ws(";", "o_orderkey", "o_custkey").alias("value"))
    ordered = lines.repartition("kind", "part").sortWithinPartitions("kind", "part", "o_orderkey").select("kind", "part", "value")
    ordered.write.partitionBy("kind", "part").option("header", "false").csv(f"{root}/files")
    files = tree.register(tree.list_files(spark, f"{root}/files")).join(tree.hash_files(spark, f"{root}/files"), "path")
    kind, part = (F.url_decode(F.regexp_extract("path", f"{name}=([^/]+)/", 1)) for name in ("kind", "part"))
    return files.select(kind.alias("kind"), part.cast("long").alias("part"), "size_bytes", "sha256", "status")


#: Ledger files of differing shape: folder, lines before the header, delimiter, encoding, mark at the start.
MESSY_FILES = (
    ("1. РЧБ июнь2025", 3, ";", "UTF-8", "\ufeff"), ("1. РЧБ июль2025", 0, ",", "UTF-8", ""),
    ("1. РЧБ август2025", 1, "\t", "windows-1251", ""), ("прочее", 0, ";", "UTF-8", ""),
)


def _cp1251(text):
    """Cyrillic and ASCII text as the characters whose ISO-8859-1 bytes are its bytes in windows-1251."""
    letters = "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯабвгдежзийклмнопрстуфхцчшщъыьэюяЁё№\ufeff"  # the last has no counterpart and goes
    latin = "".join(map(chr, [*range(0xC0, 0x100), 0xA8, 0xB8, 0xB9]))
    return F.translate(text, letters, latin)


def _write_shape(lines: DataFrame, head: list[tuple[int, str]], folder: str, encoding: str) -> None:
    """Lines ``(part, place, line)`` as one file per part, each below its own copy of the head lines."""
    above = F.explode(F.array(*[F.struct(F.lit(place).cast("long").alias("place"), F.lit(text).alias("line")) for place, text in head]))
    tops = lines.select("part").distinct().withColumn("top", above).select("part", "top.place", "top.line")
    whole = lines.unionByName(tops).repartition("part").sortWithinPartitions("part", "place").select("part", "line")
    if encoding == "windows-1251":
        whole, encoding = whole.withColumn("line", _cp1251(F.col("line"))), "ISO-8859-1"
    # One column that never needs quoting: the delimiter of the writer occurs in no line, and it knows no quote.
    whole.write.partitionBy("part").options(
        header="false", sep="\x01", quote="", escapeQuotes="false", emptyValue="", encoding=encoding,
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(folder)


@query("ingest_messy_files")
def ingest_messy_files(spark, sf_dir):
    """Line items written as exports of four shapes (mark, preamble, delimiter, encoding, repeated and blank headers, blank
    rows, files of no known source), many files of each, and imported."""
    root = _folder(spark, "messy")
    headers = [*messy.RCHB_HEADERS, "Лишний", "Лишний", ""]
    cells = [*messy.rchb_cells(), F.lit("a"), F.lit("b"), F.lit("c")]
    key = F.col("l_orderkey")
    for i, (name, preamble, delimiter, encoding, mark) in enumerate(MESSY_FILES):
        body = table(spark, sf_dir, "lineitem").where(key % len(MESSY_FILES) == i).select(
            F.floor(key / (KEYS_PER_FILE * len(MESSY_FILES))).alias("part"), F.expr("l_orderkey * 10 + l_linenumber").alias("place"),
            F.concat_ws(delimiter, *[F.coalesce(
                F.when(F.contains(c.cast("string"), F.lit(delimiter)), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c.cast("string")),
                F.lit("")) for c in cells]).alias("line"))
        head = [(-100 + k, f"отчёт{delimiter}") for k in range(preamble)] + [(-1, delimiter.join(headers)), (0, delimiter * 3)]
        _write_shape(body, [(head[0][0], mark + head[0][1]), *head[1:]], f"{root}/tree/{name}", encoding)
    done = ingest_folder(spark, f"{root}/tree", "tpch", hash_files=False)
    group = F.element_at(F.split("source_file", "/"), 1)
    return done.facts.groupBy(group.alias("file"), "kfsr_code", "kvr_code", "year", "metric").agg(
        F.count(F.lit(1)).alias("n"), A.total().alias("value"))


@query("messy_file_profiles")
def messy_file_profiles(spark, sf_dir):
    """What is found out about each file of one shape (encoding, delimiter, header, source, rows) and about one of no known source."""
    root = _folder(spark, "profiles")
    orders = table(spark, sf_dir, "orders")
    cells = [F.col("o_orderkey"), F.concat(F.lit("Ёж №"), F.col("o_custkey")), F.col("o_orderdate").cast("date"), F.lit("1"), F.col("o_custkey")]
    for name, preamble, delimiter, encoding, mark in MESSY_FILES:
        body = orders.select(F.floor(F.col("o_orderkey") / KEYS_PER_FILE).alias("part"), F.col("o_orderkey").alias("place"), F.concat_ws(
            delimiter, *[c.cast("string") for c in cells]).alias("line"))
        head = [(-100 + k, f"отчёт{delimiter}") for k in range(preamble)] + [(-1, delimiter.join(messy.RCHB_HEADERS[:5]))]
        _write_shape(body, [(head[0][0], mark + head[0][1]), *head[1:]], f"{root}/tree/{name}", encoding)
    registry = ingest_folder(spark, f"{root}/tree", "tpch", hash_files=False).registry
    return registry.select(
        F.substring_index("relative_path", "/", 1).alias("folder"), F.regexp_extract("relative_path", "part=([0-9]+)/", 1).cast("long").alias("part"),
        "source_group", "status", "encoding", "delimiter", "header_row_index", "rows_count", "raw_rows_imported", "normalized_rows_imported")


# --- Typed tables --------------------------------------------------------------------------------


def _stored(spark: SparkSession, sf_dir: str, source, name: str) -> DataFrame:
    """A typed table after two batches were stored and one of them again; the replaced one is read back."""
    store = _folder(spark, "store")
    records, profiles = source(spark, sf_dir)
    # A table of one file is one split: its records are dealt over all tasks before they are normalised, and the
    # typed rows are kept, so the three writes normalise them once.
    rows = N.typed(N.entries(dealt(records, "row_number"), N.place_columns(profiles)), name)
    rows = materialize(Q.dedup_agreements(rows) if name == "agreements" else rows, name)
    for batch, replace in (("one", False), ("two", False), ("one", True)):
        sinks.append(rows.select(F.lit(batch).alias("batch_id"), "*"), f"{store}/{name}", "batch_id", replace=replace)
    rows.unpersist()
    return spark.read.parquet(f"{store}/{name}").where("batch_id = 'one'").drop("batch_id", "raw_data")


@query("store_agreements")
def store_agreements(spark, sf_dir):
    return _stored(spark, sf_dir, messy.agreements, "agreements")


@query("store_contract_lines")
def store_contract_lines(spark, sf_dir):
    return _stored(spark, sf_dir, messy.contract_lines, "contract_budget_lines")


@query("store_payments")
def store_payments(spark, sf_dir):
    return _stored(spark, sf_dir, messy.payments, "payments")


@query("store_institution_payments")
def store_institution_payments(spark, sf_dir):
    return _stored(spark, sf_dir, messy.buau, "institution_payments")


@query("stream_import")
def stream_import(spark, sf_dir):
    """Files that land in two bursts, each imported as one batch; files of other kinds are only registered."""
    root = _folder(spark, "landing")
    cells = [c.alias(h) for h, c in zip(messy.RCHB_HEADERS, messy.rchb_cells())]
    lines = table(spark, sf_dir, "lineitem")
    for burst, flags in ((1, ("A", "N")), (2, ("R",))):
        exports = lines.where(F.col("l_returnflag").isin(*flags)).select(
            F.concat(F.lit("1. РЧБ "), F.col("l_returnflag")).alias("source"), *cells)
        exports.write.mode("append").partitionBy("source").option("header", "true").option("sep", ";").csv(f"{root}/in")
        lines.limit(1).select(F.lit("x").alias("value")).write.mode("overwrite").text(f"{root}/other/{burst}")
        jobs.import_arrivals(spark, f"{root}/in", f"{root}/store", f"{root}/marks").awaitTermination()
    facts = sinks.read_facts(spark, f"{root}/store")
    status = spark.read.parquet(f"{root}/store/import_batches").select("batch_id", "status")
    return facts.groupBy("batch_id", "kvr_code", "metric").agg(F.count(F.lit(1)).alias("n"), A.total().alias("value")).join(
        status, "batch_id")
