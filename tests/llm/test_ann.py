"""Nearest neighbours: recall against brute force, exact scores, ties, copies, unusable vectors."""

import numpy as np
import pytest

from rankweave.llm import ann


def brute(rows, queries, k):
    """(query, [(id, score)]) with ties to the smaller id."""
    ids = np.array([i for i, _ in rows])
    raw = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for q, v in queries:
        scores = (raw * np.array(v, np.float32).astype(np.float64)).sum(axis=1)
        order = sorted((n for n in range(len(ids)) if ids[n] != q), key=lambda n: (-scores[n], ids[n]))[:k]
        out[q] = [(int(ids[n]), float(scores[n])) for n in order]
    return out


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    # Small shards, so that merging is exercised.
    got = ann.nearest(table, table.filter("vec_id % 20 = 0"), 20, shard_rows=200).collect()
    hits = 0
    for r in got:
        scores = dict(want[r["query_id"]])
        hits += r["vec_id"] in scores
        if r["vec_id"] in scores:
            assert r["score"] == pytest.approx(scores[r["vec_id"]], abs=1e-15)
    assert len(got) == 20 * len(want) and hits / len(got) > 0.95
    for q in want:
        own = sorted((r["rank"], -r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [x[0] for x in own] == list(range(1, 21)) and [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_recall_with_uneven_lengths():
    rng = np.random.default_rng(2)
    raw = (rng.normal(size=(1500, 12)) * rng.uniform(0.2, 3, (1500, 1))).astype(np.float32)
    queries = rng.normal(size=(40, 12)).astype(np.float32)
    found = ann.search(ann.build(raw), queries, 10)
    best = np.argsort(-(queries @ raw.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, best)]) > 0.9


def test_copies_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100, [0.0, 1.0]), (101, [2.0, 0.0]), (102, [-1.0, 0.5])]
    bad = [(200, None), (201, [0.0, 0.0]), (202, [float("nan"), 1.0]), (203, [float("inf"), 1.0]), (204, [None, 1.0]), (205, []), (None, [1.0, 1.0]),
           (300, [1.0, 2.0, 3.0]), (301, [3.0, 2.0, 1.0])]
    table = spark.createDataFrame([(i, v, 9) for i, v in rows + bad], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.nearest(table, table, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, rows, 5) | brute([(300, [1, 2, 3]), (301, [3, 2, 1])], [(300, [1, 2, 3]), (301, [3, 2, 1])], 5)
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == want
    assert ann.nearest(table.limit(0), table, 5).count() == 0 and ann.nearest(table, table.limit(0), 5).count() == 0


def test_no_vector_needs_more_copies_than_are_kept(spark):
    rows = spark.range(5000).selectExpr("id", "array(cast(if(id % 3 = 0, 1, id) as double)) v")
    nodes, copies = ann.distinct_vectors(rows, 4)
    one = nodes.filter("v[0] = 1").first()["node"]
    assert sorted(r["id"] for r in copies.collect() if r["node"] == one) == [0, 1, 3, 6]
    assert copies.count() == 4 + len([i for i in range(5000) if i % 3 and i != 1]) and nodes.count() == copies.count() - 3


def test_repeated_rows_and_ids(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)]
    twice = rows + rows[:15] + [(5, [10.0, 50.0]), (5, [0.5, 0.5])]
    table = spark.createDataFrame(twice, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.nearest(table, table.filter("vec_id = 20"), 20).collect()]
    distinct = [*rows, (5, [10.0, 50.0]), (5, [0.5, 0.5])]
    scores = sorted(((-(20.0 * v[0] + v[1]), i) for i, v in distinct if (i, v) != (20, [20.0, 1.0])))[:20]
    assert sorted(got, key=lambda r: r[1]) == [(20, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    # Each vector of an id is asked for itself, and found by the others.
    asked = ann.nearest(table, table.filter("vec_id = 5"), 2).collect()
    assert len(asked) == 6 and sorted((r["vec_id"], r["score"]) for r in asked if r["rank"] == 1) == [(5, 30.0), (29, 146.0), (29, 340.0)]


def test_scores_of_double_vectors(spark):
    rows = [(1, [1e39, 1.0]), (2, [1.0 + 2**-40, 0.0]), (3, [0.5, 0.25])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.nearest(table, table, 5).collect()}
    assert len(got) == 6 and got[2, 1] == 1e39 * (1.0 + 2**-40) and got[2, 3] == 0.5 * (1.0 + 2**-40)


@pytest.mark.parametrize("size", [3000])
def test_recall_of_one_full_shard(size):
    raw = np.random.default_rng(0).normal(size=(size, 64))
    queries = raw[::20]
    found = ann.search(ann.build(raw), queries, 20)
    best = np.argsort(-(queries @ raw.T), axis=1, kind="stable")[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, best)]) > 0.9
