"""A typed table stored from a driver table of one file is normalised by many tasks, not by its one split."""

from pyspark.sql import functions as F

from fiscalspark.queries_store import store_institution_payments

SF = "/root/testdata/sf0.01"


def test_stored_rows_are_dealt_over_tasks(spark):
    back = store_institution_payments(spark, SF)
    # One written file per task that normalised rows of the kept batch; a single split wrote one.
    assert len([f for f in back.inputFiles() if "batch_id=one" in f]) > 1
    events = spark.read.parquet(f"{SF}/events.parquet")
    kept = events.where((F.col("event_id") % 50 != 0) & (F.col("event_id") % 50 != 1)).count()
    assert back.count() == kept
