"""The contracts of store_round_trip are normalised by many tasks, not by the one split of their file."""

from fiscalspark.queries_store import store_round_trip

SF = "/root/testdata/sf0.01"


def test_round_trip_rows_are_dealt_over_tasks(spark):
    back = store_round_trip(spark, SF)
    # One written file per task that normalised rows of the kept batch; a single split wrote one.
    assert len([f for f in back.inputFiles() if "/contracts/batch_id=one" in f]) > 1
    assert back.count() == back.select("source_file", "row_number").distinct().count() > 0
