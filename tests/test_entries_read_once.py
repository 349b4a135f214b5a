"""Entries that one output reads are not kept in executors, and no path is looked at once per record for it."""

import pytest

from fiscalspark import queries_import as I

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("run", [I.unpivot_rchb, I.raw_rows_rchb], ids=lambda run: run.__name__)
def test_entries_pass_through(spark, run):
    plan = run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan  # before, the entries of all records were held by the executors
    records = plan[plan.index("cells#"):plan.index("Aggregate [path#")]
    assert records.count("rightHint=(strategy=broadcast)") == 1  # the records are joined with the broadcast files
    filters = [line for line in plan.splitlines() if "Filter" in line and "l_returnflag" in line]
    assert filters and not any("regexp_replace(concat" in line for line in filters)


def test_facts_of_a_kept_and_of_a_passing_frame_agree(spark):
    from fiscalspark.operators import records as N
    from fiscalspark.sources import messy

    kept, passing = (N.facts(make(messy.contract_lines, spark, SF), "b") for make in (I._entries, I._read_once))
    assert kept.count() == passing.count() == 0  # lines of contracts have no amounts
    kept, passing = (N.facts(make(messy.rchb, spark, SF), "b").drop("raw_data") for make in (I._entries, I._read_once))
    assert kept.exceptAll(passing).count() == passing.exceptAll(kept).count() == 0 < kept.count()
