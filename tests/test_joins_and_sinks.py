import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankweave import scale
from rankweave.functions import tables
from rankweave.operators import simjoin as S
from rankweave.plans import queries
from rankweave.sources import commit


def family(seed, sets, size, vocabulary):
    rng = random.Random(seed)
    rows = []
    for i in range(sets):
        base = rng.sample(range(vocabulary), rng.randint(1, size))
        rows.append(base)
        for _ in range(rng.randint(0, 3)):
            rows.append([t for t in base if rng.random() > 0.15] + rng.sample(range(vocabulary), rng.randint(0, 2)))
    return rows


@pytest.mark.parametrize("threshold", [0.4, 0.7, 0.8, 1.0])
def test_similar_sets_equal_brute_force(spark, threshold):
    sets = family(4, 60, 12, 80) + [[1]] * 30 + [[1, 2], [1, 2], [2, 2, 1], None, [], [None, 7], [7]]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id INT, tokens ARRAY<INT>")
    classes, members = S.set_classes(rows, "id", "tokens")
    pairs = S.similar_sets(classes, threshold)
    clean = {i: frozenset(t for t in s or [] if t is not None) for i, s in enumerate(sets)}
    clean = {i: s for i, s in clean.items() if s}
    first = {}
    for i, s in clean.items():
        first.setdefault(s, i)
    assert {r["id"]: r["class"] for r in members.collect()} == {i: first[s] for i, s in clean.items()}
    reps = sorted((i, s) for s, i in first.items())
    want = {(i, j): len(a & b) / len(a | b) for k, (i, a) in enumerate(reps) for j, b in reps[k + 1:] if len(a & b) / len(a | b) >= threshold - 1e-12}
    got = {(r["left"], r["right"]): r["similarity"] for r in pairs.collect()}
    assert got == pytest.approx(want)
    near = {i: sum(len(a & b) / len(a | b) >= threshold - 1e-12 for j, b in clean.items() if j != i) for i, a in clean.items()}
    assert {r["id"]: r["links"] for r in S.links(members, pairs, "id").collect()} == near


def test_only_rare_tokens_are_indexed(spark):
    rows = spark.range(200).select("id", F.array(F.lit("the"), F.lit("of"), F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), "id")).alias("tokens"))
    classes, _ = S.set_classes(rows, "id", "tokens")
    index = S.prefix_index(classes, 0.8)
    assert index.filter(F.col("token").isin("the", "of")).count() == 0 and index.count() == 200
    with pytest.raises(ValueError):
        S.similar_sets(classes, 0)


def test_few_pairs_of_unlike_sets_are_verified(spark):
    """Sets over one vocabulary share many tokens; nearly all pairs end before their sets are moved."""
    rng = random.Random(8)
    sets = [rng.sample(range(1_200), 200) for _ in range(300)]
    sets += [[*s[:180], *range(2_000 + 20 * i, 2_020 + 20 * i)] for i, s in enumerate(sets[:40])]
    classes, _ = S.set_classes(spark.createDataFrame(list(enumerate(sets)), "id INT, tokens ARRAY<INT>"), "id", "tokens")
    tried = {(r["left"], r["right"]) for r in S.candidate_pairs(classes, 0.6).collect()}
    assert {(i, 300 + i) for i in range(40)} <= tried and len(tried) < 60


def test_one_set_twice_under_one_key_is_one_class(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3]), (1, [1, 2, 3]), (2, [1, 2, 3, 4])], "id INT, tokens ARRAY<INT>")
    classes, _ = S.set_classes(rows, "id", "tokens")
    assert classes.count() == 2 and S.similar_sets(classes, 0.7).count() == 1


def brute(sets, threshold):
    return {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets[:i], 0) if len(a & b) / len(a | b) >= threshold}


def test_sets_travel_once_per_family(spark):
    """A set is moved for its family, not for each of its pairs, and indexed as often whatever the number of sets."""
    rng = random.Random(2)
    sets = [[*range(1_000 * f, 1_000 * f + 20), *rng.sample(range(1_000 * f + 20, 1_000 * f + 40), 4)] for f in range(3) for _ in range(60)]
    classes, _ = S.set_classes(spark.createDataFrame(list(enumerate(sets)), "id INT, tokens ARRAY<INT>"), "id", "tokens")
    n = classes.count()
    placed = S.cells(S.candidate_pairs(classes, 0.6)).toPandas()
    assert len(placed) > 20 * n
    moved = {(c, k) for side in ("left", "right") for c, k in zip(placed["cell"], placed[side])}
    assert len(moved) <= 2 * n and S.index_entries(classes, 0.6, S.SHARES).count() <= 2 * S.SHARES * n


def test_cut_classes_and_families_lose_no_pair(spark, monkeypatch):
    for name, few in (("BLOCK_SETS", 25), ("CELL_RIGHT", 3), ("CELL_LEFT", 5), ("PAIRS_AT_ONCE", 16), ("TOKENS_AT_ONCE", 40), ("LOOKUPS", 30)):
        monkeypatch.setattr(S, name, few)
    sets = sorted({frozenset(s) for s in family(7, 60, 14, 60) if s}, key=sorted)
    classes, _ = S.set_classes(spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "id INT, tokens ARRAY<INT>"), "id", "tokens")
    want = {(j, i): x for (i, j), x in brute(sets, 0.5 - 1e-12).items()}
    assert {(r["left"], r["right"]): r["similarity"] for r in S.similar_sets(classes, 0.5).collect()} == pytest.approx(want)
    # The pieces that workers use, here with little at once.
    entries = S.index_entries(classes, 0.5, 2).toPandas()
    assert entries["block"].max() > 0
    met = set()
    for _, part in entries.groupby(["grp", "share", "block"]):
        met |= set(S._meet(pa.Table.from_pandas(part, preserve_index=False), 0.5).to_pandas().itertuples(index=False, name=None))
    assert set(want) <= met
    pairs = pa.table({"left": [a for a, _ in sorted(met)], "right": [b for _, b in sorted(met)]})
    whole = pa.table({"class": list(range(len(sets))), "items": [sorted(s) for s in sets]})
    found = S._verify(pairs, whole, 0.5).to_pandas()
    assert dict(zip(zip(found["left"], found["right"]), found["similarity"])) == pytest.approx(want)


@pytest.mark.parametrize("values", ["normal", "ties", "few"])
def test_quantiles_of_huge_groups(spark, hot, values):
    rng = random.Random(3)
    draw = {"normal": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.randrange(5)), "few": lambda: rng.random()}[values]
    rows = [("a", draw()) for _ in range(3_000)] + [(None, draw()) for _ in range(500)] + [("b", 2.5), ("c", None)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    points = [0.0, 0.01, 0.25, 0.5, 0.975, 1.0]
    got = {r["g"]: list(r["q"]) for r in scale.quantiles(df, ["g"], "v", points, "q", accuracy=100).collect()}
    want = {r["g"]: list(r["q"]) for r in df.filter("v IS NOT NULL").groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in points])).alias("q")).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], abs=1e-12) for g in want)
    whole = scale.quantiles(df, [], "v", points, "q", accuracy=100).first()["q"]
    assert list(whole) == pytest.approx(list(df.agg(F.percentile("v", F.array(*[F.lit(p) for p in points]))).first()[0]), abs=1e-12)


def test_write_once(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 7 AS v")
    path = f"file://{tmp_path}/out"
    manifest = commit.write_once(df, path)
    assert manifest["rows"] == 100 and commit.read_once(spark, path, df.schema).agg(F.sum("id")).first()[0] == 4950
    with pytest.raises(FileExistsError):
        commit.write_once(df.limit(1), path)
    assert commit.read_once(spark, path, df.schema).count() == 100 and os.listdir(tmp_path) == ["out"]
    assert commit.write_once(df.limit(0), f"file://{tmp_path}/none")["rows"] == 0


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    df = spark.range(1_000, numPartitions=8).select(F.when(F.col("id") == 999, F.raise_error(F.lit("stop here")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop here"):
        commit.write_once(df, f"file://{tmp_path}/out")
    assert os.listdir(tmp_path) == []


def test_changed_output_is_noticed(spark, tmp_path):
    df = spark.range(10).selectExpr("id")
    commit.write_once(df, f"file://{tmp_path}/out", "json")
    with open(f"{tmp_path}/out/part-extra.json", "w") as extra:
        extra.write('{"id": 1}\n')
    with pytest.raises(ValueError, match="manifest"):
        commit.read_once(spark, f"file://{tmp_path}/out", df.schema)


def test_table_function(spark):
    rows = [(1, "b", 2, 1.0), (1, "a", 1, 3.0), (2, "c", 1, 0.0), (2, "d", 2, 0.0), (3, "e", 1, 2.0)]
    spark.createDataFrame(rows, "query_id INT, cand_key STRING, rank INT, prior DOUBLE").createOrReplaceTempView("lists_of_test")
    tables.register(spark)
    got = {(r["query_id"], r["cand_key"]): tuple(r)[3:] for r in spark.sql("SELECT * FROM list_features(TABLE(lists_of_test))").collect()}
    assert got[1, "a"][:3] == (0.0, None, 0.75) and got[1, "b"][:3] == (2.0, 2.0, 0.25) and got[1, "a"][3] == pytest.approx(0.8112781244591328)
    assert got[2, "d"] == (0.0, 0.0, None, None) and got[3, "e"] == (0.0, None, 1.0, None)
    with pytest.raises(Exception, match="lacks"):
        spark.sql("SELECT * FROM list_features(TABLE(SELECT 1 AS query_id))")


def test_packed_table_function_takes_batches_of_lists(spark):
    rows = [(1, "b", 2, 1.0), (1, "a", 1, 3.0), (2, "c", 1, 0.0), (2, "d", 2, None), (3, "e", 1, 2.0), (None, "f", 1, 2.0), (None, "g", 2, 1.0)]
    lists = spark.createDataFrame(rows, "query_id INT, cand_key STRING, rank INT, prior DOUBLE")
    lists.createOrReplaceTempView("lists_of_test")
    tables.packed(lists).createOrReplaceTempView("packed_of_test")
    tables.register(spark)
    tables.register_packed(spark, lists)
    want = spark.sql("SELECT * FROM list_features(TABLE(lists_of_test))")
    got = spark.sql("SELECT * FROM packed_list_features(TABLE(packed_of_test))")
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    tables.packed(lists.limit(0)).createOrReplaceTempView("packed_of_test")
    assert spark.sql("SELECT * FROM packed_list_features(TABLE(packed_of_test))").count() == 0


def test_x03_works_on_arrow_batches(spark):
    plan = queries()["x03_table_function"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan and "BatchEvalPythonUDTF" not in plan
