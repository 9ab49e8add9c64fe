import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.operators import compare as C
from rankweave.operators import concordance as K
from rankweave.operators import idsets as B


def pairwise(items):
    """Counts and concordance by enumeration."""
    n, score, tx, ty, both, inv = len(items), 0, 0, 0, 0, 0
    for (a, b), (c, d) in itertools.combinations(items, 2):
        s = (a > c) - (a < c)
        r = (b > d) - (b < d)
        score, tx, ty, both, inv = score + s * r, tx + (s == 0), ty + (r == 0), both + (s == 0 and r == 0), inv + (s * r < 0)
    free = ((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)) ** 0.5
    return n, inv, tx, ty, both, score / free if free else None


def made(seed, n, values):
    rng = random.Random(seed)
    return [(rng.randrange(values), rng.randrange(values) / 4) for _ in range(n)]


@pytest.mark.parametrize("huge", [False, True])
def test_concordance_equals_enumeration(spark, request, huge):
    if huge:
        request.getfixturevalue("hot")
    lists = {"ties": made(1, 150, 5), "few": made(2, 40, 100), "two": [(1, 2.0), (2, 1.0)], "one": [(1, 1.0)], "flat": [(3, float(i)) for i in range(4)],
             None: made(3, 60, 8), "same": [(1, 1.0)] * 5, "sorted": [(i, float(i)) for i in range(64)], "reversed": [(i, -float(i)) for i in range(65)]}
    rows = [(k, *item) for k, items in lists.items() for item in items] + [("two", None, 1.0), ("two", 1, None)]
    got = {r["k"]: tuple(r)[1:] for r in K.order_concordance(spark.createDataFrame(rows, "k STRING, x INT, y DOUBLE"), ["k"], "x", "y").select(
        "k", "n", "inversions", "tied_x", "tied_y", "tied_both", "kendall").collect()}
    assert got.keys() == lists.keys()
    for k, items in lists.items():
        want = pairwise(items)
        assert got[k][:5] == want[:5] and (got[k][5] == pytest.approx(want[5]) if want[5] is not None else got[k][5] is None)


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 64, 65, 1000])
def test_inversions_of_one_list(n):
    rng = random.Random(n)
    for most in (2, 7, 5 * n):
        values = [rng.randrange(most) for _ in range(n)]
        assert K.count_inversions(np.array(values)) == sum(a > b for a, b in itertools.combinations(values, 2))


def test_short_lists_move_once(spark):
    """No row per binary digit where every list fits one task."""
    rows = spark.range(20_000).select((F.col("id") % 50).alias("k"), (F.col("id") * 7919 % 1009).alias("x"), (F.col("id") * 31 % 97).alias("y"))
    plan = K.order_concordance(rows, ["k"], "x", "y")._jdf.queryExecution().toString()
    assert "Generate" not in plan and "FlatMapGroupsInArrow" in plan


def test_concordance_of_5000_items(spark):
    items = made(9, 5_000, 3_000)
    row = K.order_concordance(spark.createDataFrame([(1, *i) for i in items], "k INT, x INT, y DOUBLE"), ["k"], "x", "y").first()
    want = pairwise(items)
    assert (row["n"], row["inversions"], row["tied_x"], row["tied_y"], row["tied_both"]) == want[:5] and row["kendall"] == pytest.approx(want[5], abs=1e-12)


def test_concordance_of_nothing(spark):
    assert K.order_concordance(spark.createDataFrame([], "k INT, x INT, y INT"), ["k"], "x", "y").count() == 0


SMALL = {"fanout": 8, "levels": 3, "join_rows": 10}


def test_row_differences_of_bags(spark):
    base = [(i, f"v{i % 7}") for i in range(300)] + [(None, "a"), (1, None), (5, "v5"), (5, "v5")]
    other = [r for r in base if r != (17, "v3")] + [(None, "a"), (999, None)]
    other.remove((5, "v5"))
    a, b = (spark.createDataFrame(x, "k INT, v STRING") for x in (base, other))
    got = {(r["k"], r["v"]): (r["n_left"], r["n_right"]) for r in C.row_differences(a, b, ["k", "v"], **SMALL).collect()}
    assert got == {(17, "v3"): (1, 0), (None, "a"): (1, 2), (999, None): (0, 1), (5, "v5"): (3, 2)}
    assert C.row_differences(a, a.orderBy(F.desc("k")), ["k", "v"], **SMALL).count() == 0
    assert C.row_differences(a.limit(0), a.limit(0), ["k", "v"]).count() == 0
    assert C.row_differences(a, a.limit(0), ["k", "v"]).agg(F.sum("n_left")).first()[0] == len(base)


def test_a_null_is_not_skipped(spark):
    a, b = (spark.createDataFrame([(1, *v)], "k INT, x STRING, y STRING") for v in ((None, "s"), ("s", None)))
    assert [tuple(r) for r in C.key_differences(a, b, ["k"], ["x", "y"]).collect()] == [(1, "changed", ["x", "y"])]


def test_key_differences(spark):
    base = [(i, i % 5, f"v{i}") for i in range(400)] + [(None, 1, "null")]
    other = [(i, v, s if i != 40 else "other") for i, v, s in base if i != 7] + [(1000, 0, "new")]
    other = [(i, -1 if i == 41 else v, s) for i, v, s in other]
    a, b = (spark.createDataFrame(x, "k INT, v INT, s STRING") for x in (base, other))
    got = {r["k"]: (r["change"], r["columns"]) for r in C.key_differences(a, b, ["k"], ["v", "s"], **SMALL).collect()}
    assert got == {7: ("missing", []), 1000: ("extra", []), 40: ("changed", ["s"]), 41: ("changed", ["v"])}
    with pytest.raises(Exception, match="twice"):
        C.key_differences(a.unionAll(a), b, ["k"], ["v"]).collect()


def test_only_differing_ranges_are_joined(spark):
    a = spark.range(50_000).selectExpr("id AS k", "id % 11 AS v")
    b = a.withColumn("v", F.when(F.col("k") == 4242, 99).otherwise(F.col("v")))
    left, right = C.suspects(a, b, ["k"], ["v"], fanout=64, levels=2, join_rows=100)
    assert left.count() == right.count() < 60 and left.filter("k = 4242").count() == 1


def test_id_sets(spark):
    ids = lambda *values: spark.createDataFrame([(v,) for v in values], "id LONG")
    a = [0, 1, 2, 7, 8, 32_767, 32_768, 32_769, 100_000, -1, -32_768, -70_000, 2**40]
    b = [1, 2, 3, 32_768, 100_000, -1, 5_000_000, 2**40]
    sets = {"a": ids(*a, 7, None), "b": ids(*b)}
    tagged = B.tagged_bitmaps(sets, "id")
    read = lambda t: sorted(r["id"] for r in B.members(t, "id").collect())
    assert read(B.bitmaps(sets["a"], "id")) == sorted(a)
    assert read(B.intersection(tagged, 2)) == sorted(set(a) & set(b))
    assert read(B.union(tagged)) == sorted(set(a) | set(b))
    row = B.set_sizes(tagged, "a", "b").first()
    assert tuple(row) == (len(a), len(b), len(set(a) & set(b)), len(set(a) - set(b)), len(set(b) - set(a)))
    assert tuple(B.set_sizes(B.tagged_bitmaps({"a": ids(), "b": ids()}, "id"), "a", "b").first()) == (0, 0, 0, 0, 0)


@pytest.mark.parametrize("parts, want", [
    (([1, 2], [3]), (3, 2, 1, 0, 0, 0, True)), (([1, 2], [2, 3]), (3, 2, 2, 1, 0, 0, False)), (([1], [3]), (3, 1, 1, 0, 1, 0, False)),
    (([1, 2, 3], [40_000]), (3, 3, 1, 0, 0, 1, False)), (([], []), (3, 0, 0, 0, 3, 0, False)), (([1, 2, 3], [1, 2, 3]), (3, 3, 3, 3, 0, 0, False))])
def test_partition_proof(spark, parts, want):
    from rankweave.operators import audits as A
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "id LONG")
    row = A.partition_proof(frame([1, 2, 3]), {"x": frame(parts[0]), "y": frame(parts[1])}, "id").first()
    assert tuple(row) == want
