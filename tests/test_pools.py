"""Pool operators on small hand fixtures."""

import pytest
from pyspark.sql import functions as F

from rankweave.operators import audits as A
from rankweave.operators import pools as P


def lines(spark, rows):
    return spark.createDataFrame(rows, "query_id STRING, cand_key STRING, prior DOUBLE, line_no LONG")


def listed(spark, rows):
    df = spark.createDataFrame(rows, "query_id STRING, cand_key STRING, prior DOUBLE, rank LONG")
    sizes = df.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return df.join(sizes, "query_id")


def order(df):
    return [r["cand_key"] for r in df.orderBy("query_id", "rank").collect()]


RAW = [("q", "A", 0.9, 1), ("q", "A", 0.8, 2), ("q", "B", 0.7, 3), ("q", "C", 0.6, 4)]


def test_cap_before_and_after_dedupe(spark):
    raw = lines(spark, RAW)
    assert order(P.cap_then_dedupe(raw, 2)) == ["A"]
    assert order(P.cap_then_dedupe(raw, 4)) == ["A", "B", "C"]
    assert order(P.dedupe_then_cap(raw, 2)) == ["A", "B"]


def test_winner_value_and_kept_position(spark):
    raw = lines(spark, [("q", "A", 0.2, 1), ("q", "B", 0.5, 2), ("q", "A", 0.5, 3)])
    pool = P.dedupe(raw)
    a = pool.filter("cand_key = 'A'").first()
    assert (a["prior"], a["first_seen"], a["winner_line"], a["copies"]) == (0.5, 1, 3, 2)
    assert order(P.full_list(pool)) == ["A", "B"]


def test_equal_prior_keeps_first_occurrence(spark):
    raw = lines(spark, [("q", "A", 0.5, 7), ("q", "A", 0.5, 4)])
    assert P.dedupe(raw).first()["winner_line"] == 4


def test_truth_position_two_ways(spark):
    pool = P.dedupe(lines(spark, RAW))
    queries = spark.createDataFrame([("q", "C"), ("p", "C")], "query_id STRING, truth_key STRING")
    by_rank = {r["query_id"]: r["rank"] for r in P.truth_position(queries, P.full_list(pool)).collect()}
    by_count = {r["query_id"]: (r["rank"], r["n"], r["has_pool"]) for r in P.truth_position_by_count(queries, pool).collect()}
    assert by_rank == {"q": 3, "p": 0}
    assert by_count == {"q": (3, 3, True), "p": (0, 0, False)}


def test_small_end_to_end_coverage(spark):
    queries = spark.createDataFrame(
        [(0, "p0", "train", "a"), (1, "p1", "train", "a"), (2, "p1", "valid", "b"), (3, "p3", "test", "c"), (4, "p4", "test", "d")],
        "id LONG, query_id STRING, split STRING, truth_key STRING")
    raw = lines(spark, [("p0", "a", 0.9, 1), ("p0", "x", 0.8, 2), ("p1", "b", 0.5, 3), ("p1", "b", 0.4, 4), ("p3", "y", 0.9, 5),
                        ("p3", "c", 0.3, 6), ("p4", "d", 0.2, 7)])
    pool = P.dedupe(raw)
    assert pool.filter("copies > 1").count() == 1
    located = P.truth_position(queries, P.full_list(pool)).withColumns(
        {"cluster_key": F.col("query_id"), "has_pool": F.lit(True), "n": F.lit(1)})
    rows = {r["split"]: r for r in P.coverage(located).collect()}
    assert rows["test"]["n_queries"] == 2 and rows["test"]["coverage"] == 1.0 and rows["test"]["coverage_at_1"] == 0.5
    assert rows["all"]["n_queries"] == 5 and rows["all"]["n_clusters"] == 4
    train, rest = queries.filter("split = 'train'"), queries.filter("split <> 'train'")
    assert [r["query_id"] for r in P.leakage_free(train, rest, "query_id").collect()] == ["p0"]


def test_merge_takes_larger_normalised_prior(spark):
    a = listed(spark, [("q", "A", 9.0, 1), ("q", "B", 8.0, 2), ("q", "C", 7.0, 3)])
    b = listed(spark, [("q", "C", 0.9, 1), ("q", "D", 0.1, 2)])
    rows = {r["cand_key"]: r for r in P.full_list(P.merge_sources(a, b)).collect()}
    assert (rows["C"]["prior"], rows["C"]["source_a"], rows["C"]["source_b"], rows["C"]["rank_a"]) == (1.0, 1, 1, 3)
    assert rows["B"]["prior"] == 0.5 and rows["D"]["rank_a"] is None
    assert [k for k, r in sorted(rows.items(), key=lambda x: x[1]["rank"])] == ["A", "C", "B", "D"]


def test_single_item_list_has_prior_one(spark):
    a = listed(spark, [("q", "A", 9.0, 1)])
    assert P.merge_sources(a, listed(spark, [("r", "B", 1.0, 1)])).filter("prior <> 1").count() == 0


def test_anchor_stays_and_inversion_is_seen(spark):
    anchor = listed(spark, [("q", "A", 0.4, 1), ("q", "B", 0.3, 2)])
    other = listed(spark, [("q", "C", 0.9, 1), ("q", "A", 0.8, 2), ("q", "D", 0.1, 3), ("q", "E", 0.05, 4)])
    extended = P.anchored_extension(anchor, other, 4)
    assert order(extended) == ["A", "B", "C", "D"]
    row = P.extension_diagnostics(extended).first()
    assert (row["n_anchor"], row["n_extension"], row["boundary_inversion"], row["above_floor"]) == (2, 2, True, 1)
    assert [r["cand_key"] for r in P.anchor_violations(anchor, other).collect()] == ["B"]


def test_list_agreement_kinds(spark):
    a = listed(spark, [("1", "A", 1.0, 1), ("1", "B", 0.5, 2), ("2", "A", 1.0, 1), ("2", "B", 0.5, 2), ("3", "A", 1.0, 1)])
    b = listed(spark, [("1", "A", 1.0, 1), ("1", "B", 0.5, 2), ("2", "B", 1.0, 1), ("2", "A", 0.5, 2), ("3", "A", 1.0, 1), ("3", "C", 0.1, 2)])
    got = {r["query_id"]: r["agreement"] for r in P.list_agreement(a, b).collect()}
    assert got == {"1": "same_order", "2": "same_set", "3": "different"}


def test_prefix_is_not_sorted_again(spark):
    stored = listed(spark, [("q", "A", 0.1, 1), ("q", "B", 0.9, 2), ("q", "C", 0.5, 3)])
    assert order(P.cap_prefix(stored, 2)) == ["A", "B"]


def test_comparison_of_equal_and_changed_pools(spark):
    pool = P.full_list(P.dedupe(lines(spark, RAW)))
    assert A.pool_issues(pool, pool).count() == 0
    changed = pool.withColumn("prior", F.when(F.col("cand_key") == "C", 0.95).otherwise(F.col("prior")))
    issues = {r["issue"] for r in A.pool_issues(pool, changed).collect()}
    assert issues == {"prior_tolerance_exceeded", "prior_order_inversion"}
    other = P.full_list(P.dedupe(lines(spark, [("z", "A", 0.9, 1)])))
    assert {r["issue"] for r in A.pool_issues(pool, other).collect()} == {"missing_product", "extra_product"}


def test_pairing_report_names_column_and_key(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", None)], "id LONG, s STRING, v INT")
    b = spark.createDataFrame([(1, "x", 2), (2, "y", None)], "id LONG, s STRING, v INT")
    got = {r["column"]: (r["n_differ"], r["first_key"]) for r in A.pairing_report(a, b, "id", ["s", "v"]).collect()}
    assert got == {"s": (0, None), "v": (1, 1)}


def test_partition_proof_finds_overlap_and_gap(spark):
    ids = spark.range(5).withColumnRenamed("id", "k")
    good = A.partition_proof(ids, {"a": ids.filter("k < 2"), "b": ids.filter("k >= 2")}, "k").first()
    bad = A.partition_proof(ids, {"a": ids.filter("k < 3"), "b": ids.filter("k = 2")}, "k").first()
    assert good["is_partition"] and not bad["is_partition"]
    assert (bad["n_overlap"], bad["n_missing"]) == (1, 2)


def test_replay_accepts_ties_only(spark):
    schema = "query_id LONG, cand_key STRING, rank INT, score DOUBLE, f DOUBLE"
    old = spark.createDataFrame([(1, "a", 1, 0.5, 1.0), (1, "b", 2, 0.5, 1.0), (1, "c", 3, 0.1, 2.0)], schema)
    new = spark.createDataFrame([(1, "b", 1, 0.5, 1.0), (1, "a", 2, 0.5, 1.0), (1, "c", 3, 0.1, 2.0)], schema)
    moved = spark.createDataFrame([(1, "c", 1, 0.9, 2.0), (1, "a", 2, 0.5, 1.0), (1, "b", 3, 0.5, 1.0)], schema)
    assert sorted(r["replay"] for r in A.tie_aware_replay(old, new, ["f"]).collect()) == ["same", "tie", "tie"]
    assert "changed" in {r["replay"] for r in A.tie_aware_replay(old, moved, ["f"]).collect()}


def test_missing_column_fails_at_plan_time(spark):
    from rankweave.sources.candidates import require_columns
    with pytest.raises(ValueError, match="missing"):
        require_columns(spark.range(1), ["id", "other"])


def test_overlap_counts_repeated_lines_once_and_sorts_nothing(spark):
    a = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, None), (None, 10)], "query_id INT, cand_key INT")
    b = spark.createDataFrame([(1, 10), (1, 12), (2, None), (3, 10), (3, 10), (None, 10)], "query_id INT, cand_key INT")
    out = P.overlap_by_query(a, b)
    got = {r["query_id"]: tuple(r)[1:] for r in out.collect()}
    assert got == {1: (2, 2, 1, 3, pytest.approx(1 / 3)), 2: (1, 1, 0, 2, 0.0), 3: (0, 1, 0, 1, 0.0), None: (1, 1, 0, 2, 0.0)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan
