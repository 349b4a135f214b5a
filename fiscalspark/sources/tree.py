"""Folders and archives of messy CSV exports as DataFrames."""

from __future__ import annotations

import re

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fiscalspark.functions.text import fold_case
from fiscalspark.sources import csv_profile, csv_tasks
from fiscalspark.sources.csv_profile import DEFAULT_LIMITS, Limits

# Workers receive the task code with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(csv_tasks)
cloudpickle.register_pickle_by_value(csv_profile)

CSV_GLOB = "*.[cC][sS][vV]"
ADMITTED_GLOB = "*.{[cC][sS][vV],[xX][lL][sS],[xX][lL][sS][xX],[pP][dD][fF]}"
ZIP_GLOB = "*.[zZ][iI][pP]"
#: Between an archive and its member, in the path of a member whose name several archives hold.
ARCHIVE_MARK = "!/"

# --- Fixed values ------------------------------------------------------------------------------
REGISTERED_EXTENSIONS = (".csv", ".xlsx", ".xls", ".pdf")
SKIPPED_MESSAGE = "Only CSV files are parsed at this stage; file was registered only."
# Source group -> (words anywhere in the path, numbered folder or file prefix); first match wins.
SOURCE_RULES = {
    "rchb": ("рчб", "1."),
    "agreements": ("соглаш", "2."),
    "gz": ("гз", "3."),
    "buau": ("буау", "4."),
}
CONTROL_WORD, CONTROL_GROUP, UNKNOWN_GROUP = "скк", "control_example", "unknown"
# -----------------------------------------------------------------------------------------------


def source_group(relative_path: Column) -> Column:
    inside = F.regexp_replace(relative_path, rf"(?s)^.*\.[zZ][iI][pP]{ARCHIVE_MARK}", "")
    path = F.replace(fold_case(inside), F.lit("\\"), F.lit("/"))
    rules = [
        F.when(
            F.contains(path, F.lit(word)) | F.contains(path, F.lit("/" + number)) | F.startswith(path, F.lit(number)),
            F.lit(group),
        )
        for group, (word, number) in SOURCE_RULES.items()
    ]
    control = F.when(F.contains(path, F.lit(CONTROL_WORD)), F.lit(CONTROL_GROUP))
    return F.coalesce(*rules, control, F.lit(UNKNOWN_GROUP))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^.+(\.[^.]+)$", 1))


def relative_path(file_path: Column, root: str) -> Column:
    """Path below the root; file URLs arrive percent-encoded."""
    plain = F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))
    base = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    return plain.substr(F.instr(plain, base) + F.lit(len(base)), F.length(plain))


def _binary(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(root)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below the root (no content is read)."""
    files = _binary(spark, root).select("_metadata.file_path", F.col("length").alias("size_bytes"))
    path = relative_path(F.col("file_path"), root)
    return files.select(path.alias("path"), "size_bytes").withColumn("extension", extension(F.col("path")))


def register(files: DataFrame) -> DataFrame:
    """Admitted files with their source group and status before parsing."""
    status = F.when(F.col("extension") == ".csv", "registered").otherwise("skipped")
    return files.where(F.col("extension").isin(*REGISTERED_EXTENSIONS)).select(
        "*",
        F.substring_index("path", "/", -1).alias("original_name"),
        source_group(F.col("path")).alias("source_group"),
        status.alias("status"),
        F.when(status == "skipped", SKIPPED_MESSAGE).alias("error_message"),
    )


def hash_files(spark: SparkSession, root: str) -> DataFrame:
    """SHA-256 per registered file of any size: a task streams each of its files, none is held as a whole."""
    path = relative_path(F.col("_metadata.file_path"), root)
    files = _binary(spark, root).select(path.alias("path"), F.col("_metadata.file_path").alias("address"))
    admitted = files.where(extension(F.col("path")).isin(*REGISTERED_EXTENSIONS))
    return admitted.mapInArrow(csv_tasks.hash_files, "path string, sha256 string")


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """Physical lines as raw bytes: (path, block, line, seq).

    The text source splits large files at line borders and hands bytes through undecoded; ``block`` is
    the split's offset and ``seq`` keeps the reading order within it.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", CSV_GLOB)
    return reader.text(root).select(
        relative_path(F.col("_metadata.file_path"), root).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
        F.monotonically_increasing_id().alias("seq"),
    )


def expand_archives(spark: SparkSession, root: str) -> DataFrame:
    """Members of ZIP archives in newline-aligned chunks, archives in parallel."""
    archives = _binary(spark, root, ZIP_GLOB).select(
        relative_path(F.col("_metadata.file_path"), root).alias("archive"), "content"
    )
    return archives.mapInArrow(csv_tasks.expand_archives, csv_tasks.CHUNK_FIELDS)


def whole_archives(chunks: DataFrame) -> DataFrame:
    """Chunks of the archives without a problem; a member name that several of them hold gets its archive in front."""
    refused = chunks.where(F.col("problem").isNotNull()).select("archive").distinct()
    whole = chunks.join(refused, "archive", "left_anti")
    repeated = whole.groupBy("path").agg(F.count_distinct("archive").alias("archives")).where("archives > 1")
    path = F.when(F.col("archives").isNull(), F.col("path")).otherwise(F.concat("archive", F.lit(ARCHIVE_MARK), "path"))
    return whole.join(repeated, "path", "left").withColumn("path", path).select(*chunks.columns)


def archive_files(chunks: DataFrame) -> DataFrame:
    sizes = chunks.where(F.col("problem").isNull()).groupBy("path").agg(F.max("size").alias("size_bytes"))
    return sizes.withColumn("extension", extension(F.col("path")))


def archive_lines(chunks: DataFrame) -> DataFrame:
    csv_chunks = chunks.where(F.col("problem").isNull() & (extension(F.col("path")) == ".csv"))
    return csv_chunks.select("path", "block", "content").mapInArrow(
        csv_tasks.chunk_lines, "path string, block long, line binary, seq long"
    )


def index_blocks(lines: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """One row per file block with all that is needed to parse it on its own.

    Only block summaries are shuffled: a few numbers per block and the first lines of each file.
    """
    summary = lines.select("path", "block", "line").mapInArrow(csv_profile.summarize(limits), csv_profile.SUMMARY_FIELDS)
    return (
        summary.withColumn("source_group", source_group(F.col("path")))
        .groupBy("path").applyInPandas(csv_tasks.index_blocks(limits), csv_tasks.BLOCK_FIELDS)
    )


def profiles(blocks: DataFrame) -> DataFrame:
    """One row per parsed file: encoding, delimiter, header and number of data rows."""
    return blocks.where(F.col("headers").isNotNull()).select(
        "path", source_group(F.col("path")).alias("source_group"), "encoding", "delimiter",
        "header_row_index", "headers", "problem",
        F.greatest(F.col("records_total") - F.col("header_row_index") - 1, F.lit(0)).alias("rows_count"),
    )


def parse_blocks(lines: DataFrame, blocks: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Parsed records, pieces of records cut by block borders, and problems (``csv_tasks.RECORD_FIELDS``).

    Spark picks the join by the real size of the block index. The sort restores the reading order in
    case that was a shuffled join; a block comes from one task, so it always stays in one partition.
    """
    profile = ["encoding", "delimiter", "starts_open", "first_record", "header_row_index"]
    readable = blocks.where(F.col("problem").isNull()).select("path", "block", *profile)
    placed = lines.join(readable, ["path", "block"]).sortWithinPartitions("path", "block", "seq")
    return placed.select("path", "block", "line", *profile).mapInArrow(csv_tasks.parse(limits), csv_tasks.RECORD_FIELDS)


def read_records(parsed: DataFrame, blocks: DataFrame, limits: Limits = DEFAULT_LIMITS) -> tuple[DataFrame, DataFrame]:
    """Data records ``(path, row_number, cells)`` and problems ``(path, message)``.

    ``parsed`` is read three times, so callers keep it. A record cut by a block border is glued from
    its pieces: at most one per border, each no longer than the CSV cell limit allows.
    """
    file_facts = blocks.where(F.col("headers").isNotNull()).select("path", "delimiter", "header_row_index")
    pieces = parsed.where("is_fragment").groupBy("path", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "cells"))).alias("pieces")
    ).withColumn("lines", F.flatten(F.col("pieces.cells")))
    glued = pieces.join(file_facts, "path").where(F.col("record") > F.col("header_row_index")).select(
        "path", "record", "lines", "delimiter"
    ).mapInArrow(csv_tasks.join_fragments(limits), csv_tasks.RECORD_FIELDS)

    everything = parsed.where(~F.col("is_fragment")).unionByName(glued)
    records = everything.where(F.col("problem").isNull()).select(
        "path", (F.col("record") + 1).alias("row_number"), "cells"
    )
    while_parsing = everything.where(F.col("problem").isNotNull())
    found = [df.select("path", F.col("problem").alias("message"))
             for df in (blocks.where(F.col("problem").isNotNull()), while_parsing)]
    return records, found[0].unionByName(found[1]).groupBy("path").agg(F.min("message").alias("message"))
