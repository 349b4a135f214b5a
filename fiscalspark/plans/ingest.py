"""Import of a folder or of archives: files -> raw rows, facts, typed tables and bookkeeping."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from fiscalspark.operators import bookkeeping as B, quarantine as Q, records as N
from fiscalspark.sources import tree
from fiscalspark.sources.csv_profile import DEFAULT_LIMITS, Limits


@dataclass(frozen=True)
class Import:
    batch_id: str
    raw_rows: DataFrame
    facts: DataFrame
    tables: dict[str, DataFrame]
    registry: DataFrame
    batch: DataFrame
    errors: DataFrame
    _held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self._held:
            df.unpersist()


@dataclass(frozen=True)
class Normalized:
    """Outputs of the record normalisers after quarantine and snapshot dedup."""

    raw_rows: DataFrame
    facts: DataFrame
    tables: dict[str, DataFrame]
    problems: DataFrame
    counts: DataFrame


def materialize(df: DataFrame, _name: str, held: list[DataFrame] | None = None) -> DataFrame:
    """Keep a result that several outputs read, so the raw files are not parsed once per output.

    It is persisted with its lineage intact: nothing runs until an output is read, a lost executor's part is computed
    again, and nothing stays behind once `Import.release` or the end of the session drops it.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    if held is not None:
        held.append(kept)
    return kept


def normalize(records: DataFrame, profiles: DataFrame, batch_id: str, read_problems: DataFrame | None = None,
              keep=materialize) -> Normalized:
    entry = keep(N.entries(records, N.place_columns(profiles)), "entries")
    files = keep(B.per_file(entry), "files")
    problems = Q.file_problems(files, read_problems)
    healthy = Q.without_failed_files(entry, problems)
    agreement = F.col("kind") == "agreement"
    tables = {name: N.typed(healthy, name) for name in N.TYPED_TABLES}
    tables["agreements"] = Q.dedup_agreements(tables["agreements"])
    agreement_facts = Q.first_snapshots(N.facts(healthy.where(agreement), batch_id))
    other_facts = N.facts(healthy.where(~agreement), batch_id)
    return Normalized(
        raw_rows=N.raw_rows(healthy), facts=other_facts.unionByName(agreement_facts), tables=tables,
        problems=problems, counts=B.imported_counts(files, healthy),
    )


def count_rows(records: DataFrame, profiles: DataFrame, read_problems: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Problems and counters alone, without keeping any entry: one pruned pass for the files, one over agreements."""
    entry = N.entries(records, N.place_columns(profiles))
    files = materialize(B.per_file(entry), "files")
    problems = Q.file_problems(files, read_problems)
    return problems, B.imported_counts(files, Q.without_failed_files(entry, problems))


def ingest_lines(files: DataFrame, lines: DataFrame, batch_id: str, hashes: DataFrame | None = None,
                 archive_problems: DataFrame | None = None, limits: Limits = DEFAULT_LIMITS) -> Import:
    """Import files whose physical lines ``(path, block, line, seq)`` are already at hand."""
    held: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name, held)

    blocks = keep(tree.index_blocks(lines, limits), "blocks")
    profiles = tree.profiles(blocks)
    parsed = keep(tree.parse_blocks(lines, blocks, limits), "parsed")
    records, read_problems = tree.read_records(parsed, blocks, limits)
    out = normalize(records, profiles, batch_id, read_problems, keep)
    registry = keep(
        B.file_registry(tree.register(files), profiles, out.problems, out.counts, hashes), "registry")
    errors = Q.error_log(out.problems, batch_id)
    if archive_problems is not None:
        errors = errors.unionByName(Q.error_log(archive_problems, batch_id))
    return Import(
        batch_id=batch_id, raw_rows=out.raw_rows.select(F.lit(batch_id).alias("batch_id"), "*"),
        facts=out.facts,
        tables={name: t.select(F.lit(batch_id).alias("batch_id"), "*") for name, t in out.tables.items()},
        registry=registry.select(F.lit(batch_id).alias("batch_id"), "*"),
        batch=B.batch_rollup(files, registry, batch_id), errors=errors, _held=held,
    )


def ingest_folder(spark: SparkSession, root: str, batch_id: str | None = None, hash_files: bool = True,
                  limits: Limits = DEFAULT_LIMITS) -> Import:
    batch_id = batch_id or str(uuid.uuid4())
    hashes = tree.hash_files(spark, root) if hash_files else None
    return ingest_lines(tree.list_files(spark, root), tree.read_lines(spark, root), batch_id, hashes, limits=limits)


def ingest_archives(spark: SparkSession, root: str, batch_id: str | None = None, limits: Limits = DEFAULT_LIMITS) -> Import:
    """ZIP archives below the root; one that is damaged or tries to write outside itself is refused as a whole."""
    batch_id = batch_id or str(uuid.uuid4())
    chunks = tree.expand_archives(spark, root)
    refused = chunks.where(F.col("problem").isNotNull()).select(
        F.col("archive").alias("path"), F.col("problem").alias("message"))
    whole = tree.whole_archives(chunks)
    return ingest_lines(tree.archive_files(whole), tree.archive_lines(whole), batch_id, None, refused, limits)
