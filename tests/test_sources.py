"""Files in and out, and streaming ingest with a restart."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from rankweave.sources import candidates as C
from rankweave.sources import results as R
from rankweave.streaming import ingest as I

LINES = [
    '{"product": "P1", "reactant": "b.a", "prior": 0.5}', "", '{"product": "P1", "reactant": "a.b", "prior": 0.7}',
    "{bad", "[1]", '{"product": "P1", "reactant": "c"}', '{"product": "P1", "reactant": "c", "prior": "x"}',
    '{"product": "P1", "reactant": "c", "prior": "inf"}', '{"product": " ", "reactant": "c", "prior": 1}',
    '{"product": "P2", "reactant": ".", "prior": 1}', '{"product": "P2", "reactant": "d", "prior": "0.25"}',
]


def test_strict_scan_counts_every_fault(spark, tmp_path):
    path = tmp_path / "pool.jsonl"
    path.write_text("\n".join(LINES) + "\n")
    lists, audit = C.read_candidates(spark, str(path))
    row = audit.first().asDict()
    assert row == {
        "physical_lines": 11, "blank_lines": 1, "candidate_records": 5, "malformed_json_lines": 2, "missing_required_fields": 1,
        "invalid_prior_records": 1, "nonfinite_prior_records": 1, "invalid_product_records": 1, "invalid_reactant_records": 1,
        "canonical_duplicate_records": 1, "unique_products": 2, "unique_candidates": 2}
    got = [(r["query_id"], r["cand_key"], r["prior"], r["first_seen"]) for r in lists.orderBy("query_id").collect()]
    assert got == [("p1", "a.b", 0.7, 1), ("p2", "d", 0.25, 11)]
    parsed = C.classify(C.read_lines(spark, str(path)))
    assert C.rejected(parsed).count() == 2 and C.fatal(parsed).count() == 5
    assert C.tolerant_audit(parsed).first().asDict() == {"lines": 10, "malformed": 2, "invalid": 5, "kept": 3}


def test_reactions_from_csv(spark, tmp_path):
    source = tmp_path / "source.csv"
    source.write_text("reactants_smiles,products_smiles,set\nb.a,P1,train\n,P2,train\nc,P3,test\n")
    meta = tmp_path / "meta.csv"
    meta.write_text("reaction_id,source_split,reaction_class\n0,train,4\n2,test,7\n")
    rows = C.read_reactions(spark, str(source), str(meta)).orderBy("query_id").collect()
    assert [(r["query_id"], r["truth_key"], r["usable"], r["reaction_class"]) for r in rows] == [
        (0, "a.b", True, 4), (1, None, False, None), (2, "c", True, 7)]
    meta.write_text("reaction_id,source_split,reaction_class\n0,valid,4\n")
    with pytest.raises(Exception, match="split differs"):
        C.read_reactions(spark, str(source), str(meta)).collect()
    meta.write_text("reaction_id,source_split,reaction_class\n0,train,4\n0,train,5\n")
    with pytest.raises(Exception, match="occurs twice"):
        C.read_reactions(spark, str(source), str(meta)).collect()
    source.write_text("wrong,products_smiles,set\na,b,c\n")
    with pytest.raises(Exception):
        C.read_reactions(spark, str(source)).collect()


def test_lines_of_several_files_follow_their_names(spark, tmp_path):
    # The later file is much longer, so Spark reads it first.
    (tmp_path / "part-0.txt").write_text("first\n")
    (tmp_path / "part-1.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    (tmp_path / "part-2.txt").write_text("last one\nlast\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = C.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["value"] for r in rows] == ["first", *[f"line {i}" for i in range(5000)], "last one", "last"]
    assert [r["line_no"] for r in rows] == list(range(1, 5004))


def test_predictions_must_be_unique_and_named(spark, tmp_path):
    def write(text, name="seed_4.csv"):
        for old in tmp_path.glob("*.csv"):
            old.unlink()
        (tmp_path / name).write_text(text)
        return R.read_predictions(spark, str(tmp_path), "query_id LONG, rank LONG")

    assert [tuple(r) for r in write("query_id,rank\n1,2\n2,1\n").orderBy("query_id").collect()] == [(1, 2, 4), (2, 1, 4)]
    for text, name, message in (("query_id,rank\n1,2\n1,3\n", "seed_4.csv", "not unique"), ("id,place\n1,2\n", "seed_4.csv", "."), ("query_id,rank\n1,2\n", "x.csv", "no seed")):
        with pytest.raises(Exception, match=message):
            write(text, name).collect()


def test_decoded_cells_take_the_winners_position(spark):
    rows = spark.createDataFrame([(1, "('a', 0.2)\t('b', 0.5)\t?\t('a', 0.5)\t('c', 0.9)")], "query_id INT, value STRING")
    got = [(r["cand_key"], r["pos"], r["prior"]) for r in C.decode_cells(rows, 3).orderBy("rank").collect()]
    assert got == [("c", 4, 1.0), ("b", 1, 0.5), ("a", 3, 0.0)]
    assert C.decode_audit(rows).first().asDict() == {"cells": 5, "invalid_cells": 1}


def test_writers_refuse_to_overwrite(spark, tmp_path):
    df, path = spark.range(3), str(tmp_path / "out")
    for kind in ("json", "csv", "parquet"):
        R.write_records(df, f"{path}-{kind}", kind)
        with pytest.raises(Exception, match="(?i)exist"):
            R.write_records(df, f"{path}-{kind}", kind)


def test_prediction_seed_from_path(spark, tmp_path):
    for seed in (42, 43):
        spark.createDataFrame([(1, seed)], "query_id LONG, rank LONG").coalesce(1).write.option("header", True).csv(str(tmp_path / f"seed_{seed}"))
    got = R.read_predictions(spark, str(tmp_path / "seed_*"), "query_id LONG, rank LONG").orderBy("seed").collect()
    assert [(r["rank"], r["seed"]) for r in got] == [(42, 42), (43, 43)]


def test_nested_metrics(spark):
    record = json.dumps({"base": {"42": {"within": {"top1": 0.5}}, "43": {"within": {"top1": 0.7}}}})
    got = R.nested_metrics(spark.createDataFrame([(record,)], "r STRING"), "r").groupBy("arm").agg(F.avg("value")).first()
    assert got[1] == pytest.approx(0.6)


def test_effect_outside_interval_is_an_error(spark):
    rows = spark.createDataFrame([(0.5, 0.6, 0.7)], "effect DOUBLE, low DOUBLE, high DOUBLE")
    with pytest.raises(Exception, match="outside"):
        R.tidy_effects([(rows, {"effect": "effect", "low": "low", "high": "high"})]).collect()


SCHEMA = "query_id LONG, cand_key LONG, prior DOUBLE, line_no LONG"


def chunk(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/chunk-{uuid.uuid4().hex}")


def test_ingest_resumes_and_ignores_order(spark, tmp_path):
    first = [(1, 1, 0.5, 1), (1, 2, 0.9, 2), (1, None, 0.1, 3)]
    later = [(1, 1, 0.8, 4), (1, 2, 0.9, 5), (2, 1, -1.0, 6)]
    pools = []
    for name, chunks in (("x", [first, later]), ("y", [later, first])):
        folder, table = str(tmp_path / name), str(tmp_path / f"{name}-table")
        for rows in chunks:
            chunk(spark, folder, rows)
            I.ingest_files(spark, f"{folder}/*", table, str(tmp_path / f"{name}-check"), SCHEMA)
        pools.append(sorted(tuple(r) for r in I.ingested_pool(spark, table, SCHEMA).drop("winner_line").collect()))
        counts = {r["status"]: r["n"] for r in I.status_counts(spark, table, SCHEMA).collect()}
        assert counts == {"ok": 4, "empty": 1, "policy_error": 1}
    assert pools[0] == pools[1] == [(1, 1, 0.8, 1, 2), (1, 2, 0.9, 2, 2)]


def test_running_winners_over_batches(spark, tmp_path):
    folder, table, check = (str(tmp_path / n) for n in ("in", "winners", "check"))
    chunk(spark, folder, [(1, 1, 0.5, 1), (1, 2, 0.9, 2)])
    I.run_winners(spark, f"{folder}/*", table, check, SCHEMA, 1)
    chunk(spark, folder, [(1, 1, 0.8, 3)])
    I.run_winners(spark, f"{folder}/*", table, check, SCHEMA, 1)
    got = sorted(tuple(r) for r in I.latest_winners(spark, table).collect())
    assert got == [(1, 1, 0.8, 1, 2), (1, 2, 0.9, 2, 1)]
