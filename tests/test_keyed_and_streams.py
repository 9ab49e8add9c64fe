import os

from pyspark.sql import functions as F

from rankweave.operators.pools import dedupe
from rankweave.sources import keyed as K
from rankweave.streaming import ingest as I

SCHEMA = "query_id LONG, cand_key LONG, prior DOUBLE, line_no LONG"


def test_a_lookup_reads_few_rows(spark, tmp_path):
    rows = spark.range(200_000).selectExpr("id AS k", "hash(id) AS v", "uuid() AS filler").repartition(6)
    path = K.write_keyed(rows, "k", f"file://{tmp_path}/t", row_group_bytes=200_000)
    table = K.read_keyed(spark, path, "k LONG, v INT, filler STRING")
    wanted = spark.createDataFrame([(5,), (123_456,), (123_456,), (None,), (10**9,)], "id LONG")
    found = K.lookup_keys(table, "k", wanted)
    assert sorted(r["k"] for r in found.collect()) == [5, 123_456]
    assert K.scanned_rows(K.lookup_keys(table, "k", wanted)) < 40_000 < K.scanned_rows(table)
    joined = K.lookup_keys(table, "k", wanted, filtered=2)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, found.collect()))
    assert K.lookup_keys(table, "k", wanted.limit(0)).count() == 0


def lines(spark, part):
    return spark.range(part * 200, part * 200 + 300).selectExpr(
        "id % 40 AS query_id", "id % 7 AS cand_key", "cast((id * 37) % 101 as double) AS prior", f"id * 10 + {part} AS line_no")


def test_restart_in_mid_stream_and_bounded_storage(spark, tmp_path):
    source, target, checkpoint = (f"{tmp_path}/{n}" for n in ("source", "winners", "checkpoint"))
    seen = None
    for part in range(7):
        lines(spark, part).coalesce(1).write.mode("append").parquet(source)
        seen = lines(spark, part) if seen is None else seen.unionAll(lines(spark, part))
        # Every run goes on from the checkpoint of the one before.
        I.run_winners(spark, source, target, checkpoint, SCHEMA, files_per_batch=1, compact_every=3)
        want = dedupe(seen).select("query_id", "cand_key", "prior", "first_seen", "copies")
        got = I.latest_winners(spark, target)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        folders = os.listdir(target)
        assert len([f for f in folders if f.startswith("base=")]) <= 1 and len([f for f in folders if f.startswith("version=")]) < 3
    keys = seen.select("query_id", "cand_key").distinct().count()
    stored = sum(spark.read.parquet(f"{target}/{f}").count() for f in os.listdir(target))
    assert stored <= keys * 3


def test_the_table_is_the_state(spark, tmp_path, monkeypatch):
    """No executor keeps keys between batches, and merges come at doubled sizes, not at every second batch."""
    source, target, checkpoint = (f"{tmp_path}/{n}" for n in ("source", "winners", "checkpoint"))
    rows = spark.range(16_000).selectExpr("id AS query_id", "nullif(id % 7, 0) AS cand_key", "cast(nullif(id % 5, 0) AS double) AS prior", "id AS line_no")
    rows = rows.unionAll(rows.selectExpr("query_id", "cand_key", "-prior", "line_no - 1"))
    rows.repartitionByRange(16, "line_no").write.parquet(source)
    merged, compact = [], I.compact_winners
    monkeypatch.setattr(I, "compact_winners", lambda *a: (merged.append(a), compact(*a)))
    I.run_winners(spark, source, target, checkpoint, SCHEMA, files_per_batch=1, compact_every=2)
    assert not os.path.exists(f"{checkpoint}/state") and 2 <= len(merged) <= 5
    want = rows.groupBy("query_id", "cand_key").agg(F.max("prior"), F.min("line_no"), F.count("*"))
    assert sorted(map(str, I.latest_winners(spark, target).toPandas().itertuples(index=False, name=None))) == sorted(
        map(str, want.toPandas().itertuples(index=False, name=None)))


def test_a_batch_that_was_merged_is_not_counted_again(spark, tmp_path):
    target = f"{tmp_path}/winners"
    rows = spark.createDataFrame([(1, 2, 3.0, 4, 5, 0)], I._WINNERS)
    rows.write.parquet(f"{target}/version=0")
    I.compact_winners(spark, target)
    I.compact_winners(spark, target)
    assert sorted(os.listdir(target)) == ["base=0"] and I.latest_winners(spark, target).select(F.sum("copies")).first()[0] == 5
    assert I.latest_winners(spark, f"{tmp_path}/none").count() == 0
