"""Work that queries over several pools do once."""

from __future__ import annotations

import pytest
from rankweave.operators.diagnostics import gap_groups
from rankweave.plans import views as V
from rankweave.plans.aggregations import descriptors
from rankweave.plans.inference import gap_effects
from rankweave.plans.registry import Tables

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("make", [V.effects, V.ranks])
def test_pools_of_one_query_are_worked_out_once(spark, make):
    t = Tables(spark, DATA)
    plan = make(t, V.POOLS)._jdf.queryExecution().optimizedPlan().toString()
    # Answers and the pools that the merged one uses again are read where they were written.
    assert {"lines", "orders", "queries", "pool_alpha", "pool_beta"} <= set(t.shared)
    assert "lineitem.parquet" not in plan
    assert V.short(t)


def test_descriptors_of_all_pools_work_lines_out_once(spark):
    t = Tables(spark, DATA)
    wide = descriptors(t)
    assert {"lines", "orders", "queries", "pool_alpha", "pool_beta", "lists_historical"} <= set(t.shared)
    assert not set(wide.inputFiles()) & set(t.lineitem.inputFiles())
    # Only the merged pool's rows, which a full outer join makes, are dealt by query again, for its lists and their entropy.
    assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4


def test_gap_effects_work_lines_out_once(spark):
    spark.conf.set("spark.rankweave.smallInputBytes", "0")
    try:
        t = Tables(spark, DATA)
        made = gap_effects(t)
        gaps = gap_groups(V.lists(t, "historical"))
    finally:
        spark.conf.unset("spark.rankweave.smallInputBytes")
    lines = set(t.shared.get("lines", t.lineitem).inputFiles())
    # Ranks and gaps read lines laid together; the groups read the gaps where they were written, as do the quartile cuts.
    assert {"lines", "orders"} <= set(t.shared) and not set(made.inputFiles()) & set(t.lineitem.inputFiles())
    assert gaps.inputFiles() and not set(gaps.inputFiles()) & lines
