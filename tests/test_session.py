"""Partition counts that follow the input."""

from __future__ import annotations

import os

from rankweave import session
from rankweave.plans.registry import Tables

DATA = "/root/testdata/sf0.001"


def test_partitions_follow_the_input(spark, monkeypatch, tmp_path):
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = Tables(spark, DATA)
    assert t.lineitem and session.partitions(spark) == own
    monkeypatch.setattr(session, "PARTITION_BYTES", 10_000)
    t = Tables(spark, DATA)
    size = os.path.getsize(f"{DATA}/lineitem.parquet")
    assert t.lineitem and session.partitions(spark) == -(-size // 10_000) > own
    assert t.lineitem.groupBy("l_orderkey").count().count() > 0
    monkeypatch.undo()
    Tables(spark, DATA)
    assert session.partitions(spark) == own
