"""A corpus pipeline over the table of documents.

Stages: toxic documents go; one of each set of equal texts stays; one of each near-duplicate component stays; documents
contaminated by the benchmark go; what is left is encoded by byte-level BPE. Every stage works on all documents that the
one before kept, and all but the last return the columns of documents. Every row is judged by its own text, whether or
not it has an identifier or shares it with another: stages that join tell rows apart by identifier and digest of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fiscalspark.llm import byte_bpe, content_sort, decontaminate, ngram_join, scratch, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of a model fitted on these documents and the visible labels."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.keep_below(docs, model, toxicity.THRESHOLD)


def _keyed(docs: DataFrame, digest: Column) -> DataFrame:
    """Whole rows as ``row`` beside ``id`` and ``digest``, so that no column of the documents can clash with a helper."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), digest.alias("digest"))


def _kept_once(keyed: DataFrame, kept: DataFrame, *order: Column) -> DataFrame:
    """One row for each (id, digest) of ``kept``: the least by ``order``, then by its other columns, so a task that runs
    again chooses alike."""
    same = keyed["id"].eqNullSafe(kept["kept_id"]) & (keyed["digest"] == kept["kept_digest"])
    others = [F.col(f"row.`{name}`") for name in keyed.schema["row"].dataType.names if name not in ("doc_id", "text")]
    first = F.min_by("row", F.struct(*order, F.to_json(F.struct(*others)) if others else F.lit("")))
    return keyed.join(kept, same, "left_semi").groupBy("id", "digest").agg(first.alias("row")).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest identifier of each set of equal texts stays, once; of rows that share it and differ in
    white space, the one whose text has the smallest digest."""
    kept = content_sort.exact_groups(docs).where("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_digest"))
    keyed = _keyed(docs, F.sha2(content_sort.normalised(F.col("text")), 256))
    return _kept_once(keyed, kept, F.sha2("row.text", 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, of the smallest identifier (null last); so does each text without words."""
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = _keyed(docs.where(worded), F.unhex(F.sha2("text", 256)))
    # Rows equal in both are one; as the key holds the text, a component's smallest key is in no other component.
    key = F.struct(F.col("id").isNull().alias("missing"), "id", "digest")
    near = ngram_join.near_duplicates(keyed.select(key.alias("key"), F.col("row.text").alias("text")), "key")
    kept = near.where("key = component_id").select(
        F.col("key.id").alias("kept_id"), F.col("key.digest").alias("kept_digest")).distinct()
    return _kept_once(keyed, kept).unionByName(docs.where(~worded))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_documents(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the identifiers and of the bytes that they decode to."""
    import public_tokenizers as P

    return byte_bpe.round_trip_digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


STAGES = [(name, scratch.with_package(stage)) for name, stage in (
    ("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated), ("byte-level BPE", encode),
)]
#: The toxicity model is trained and the encoding is a library's: no SQL; tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is a table in the shared folder that the next one reads."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
