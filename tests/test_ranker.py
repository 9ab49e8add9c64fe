import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.operators import ranker as R

FEATURES = ("a", "b", "c")


def made_pairs(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    pos, neg = rng.normal(0.4, 1, (n, 3)), rng.normal(0, 1, (n, 3))
    rows = [(i // 4, i, n + i, *map(float, pos[i]), *map(float, neg[i])) for i in range(n)]
    return spark.createDataFrame(rows, ["query_id", "pos_key", "neg_key", *[f"pos_{f}" for f in FEATURES], *[f"neg_{f}" for f in FEATURES]])


def made_lists(spark, queries=80, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for q in range(queries):
        for rank in range(1, 7):
            truth = rank == 1 + q % 6 and q % 9 != 0
            x = rng.normal(0.8 if truth else 0, 1, 3)
            rows.append((q, rank * 10, rank, truth, *map(float, x)))
    return spark.createDataFrame(rows, ["query_id", "cand_key", "rank", "is_truth", *FEATURES])


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(3)
    model = R.fresh_model(3, (5, 4), 7)
    model = model.like(model.flat() + rng.normal(0, 0.1, model.flat().size))
    pos, neg = rng.normal(size=(40, 3)), rng.normal(size=(40, 3))
    _, slope = model.gradient(pos, neg, 0.3)
    for i in range(slope.size):
        ends = []
        for step in (-1e-6, 1e-6):
            moved = model.flat()
            moved[i] += step
            ends.append(model.like(moved).gradient(pos, neg, 0.3)[0])
        assert slope[i] == pytest.approx((ends[1] - ends[0]) / 2e-6, abs=2e-5)


def test_distributed_gradient_is_the_mean_and_does_not_depend_on_partitions(spark):
    pairs = made_pairs(spark)
    model = R.fresh_model(3, (4, 3), 1)
    found = []
    for frame in (pairs.repartition(1), pairs.repartition(7, "pos_a"), pairs.orderBy(F.desc("neg_b"))):
        data = R.prepare_pairs(frame, FEATURES, block_pairs=100)
        assert data.blocks == 6 and data.pairs == 600
        found.append(R.gradient(data, model))
    assert all(loss == found[0][0] and (slope == found[0][1]).all() for loss, slope in found)
    local = pairs.toPandas()
    side = lambda s: (local[[f"{s}_{f}" for f in FEATURES]].to_numpy() - data.mean) / data.deviation
    loss, slope = model.gradient(side("pos"), side("neg"), 0.0)
    assert found[0][0] == pytest.approx(loss / 600, abs=1e-9) and found[0][1] == pytest.approx(slope / 600, abs=1e-9)
    both = [R.gradient(data, model, step=s, steps=2) for s in (0, 1)]
    sizes = [data.table.filter(f"block % 2 = {s}").count() for s in (0, 1)]
    assert sum(g[1] * n for g, n in zip(both, sizes)) / 600 == pytest.approx(found[0][1], abs=1e-9)


def test_no_exchange_of_pairs(spark):
    data = R.prepare_pairs(made_pairs(spark), FEATURES, block_pairs=100)
    plan = data.table.groupBy("block").applyInArrow(lambda t: t, data.table.schema)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_scores_of_all_layers(spark):
    model = R.layered([[[1.0, -1.0], [0.5, 2.0]], [[1.0], [-3.0]]], [[0.0, 0.5], [0.25]])
    rows = [(1.0, 2.0), (-1.0, 0.0), (0.0, -4.0), (None, 1.0)]
    got = [r["score"] for r in R.layered_score(spark.createDataFrame(rows, "x DOUBLE, y DOUBLE"), ["x", "y"], model).collect()]
    want = [max(x + 0.5 * y, 0) - 3 * max(-x + 2 * y + 0.5, 0) + 0.25 for x, y in rows[:3]]
    assert got[:3] == pytest.approx(want) and got[3] is None
    again = R.LayeredModel.from_json(model.to_json())
    assert (again.flat() == model.flat()).all()
    with pytest.raises(ValueError):
        R.layered([[[1.0, 2.0]], [[1.0]]], [[0.0, 0.0], [0.0]])


def test_mrr_with_ties_and_missing_answers(spark):
    rows = [(1, 1, 1, False, 2.0), (1, 2, 2, True, 2.0), (1, 3, 3, True, 5.0), (2, 1, 1, False, 1.0), (2, 2, 2, True, 1.0), (3, 1, 1, False, 1.0)]
    lists = spark.createDataFrame(rows, "query_id INT, cand_key INT, rank INT, is_truth BOOLEAN, score DOUBLE")
    assert R.list_mrr(lists) == pytest.approx((1 + 0.5 + 0) / 3)
    assert R.list_mrr(lists.limit(0)) == 0.0


def test_fit_improves_repeats_and_stops(spark):
    data = R.prepare_pairs(made_pairs(spark), FEATURES, block_pairs=300)
    lists = R.prepare_lists(made_lists(spark), FEATURES, data)
    fits = [R.fit_layered(data, lists, (6,), seed=3, max_epochs=14, patience=4, learning_rate=0.05) for _ in range(2)]
    assert fits[0].history == fits[1].history and (fits[0].model.flat() == fits[1].model.flat()).all()
    history = fits[0].history
    assert history[-1][1] < history[0][1]
    # The kept epoch is the first that no later one beats by more than the least gain.
    best, kept = -1.0, 0
    for epoch, _, mrr, chosen in history:
        assert chosen == (mrr > best + R.LEAST_GAIN)
        if chosen:
            best, kept = mrr, epoch
    assert (fits[0].best_epoch, fits[0].best_mrr) == (kept, best)
    assert fits[0].best_mrr == R.list_mrr(R.layered_score(lists, FEATURES, fits[0].model))


def test_stop_round(spark, monkeypatch):
    data = R.prepare_pairs(made_pairs(spark, 40), FEATURES)
    lists = made_lists(spark, 4)
    curve = iter([0.5, 0.6, 0.6 + 5e-6, 0.55, 0.6, 0.9, 0.1])
    monkeypatch.setattr(R, "list_mrr", lambda scored: next(curve))
    fit = R.fit_layered(data, lists, (2,), max_epochs=7, patience=3)
    assert (fit.best_epoch, len(fit.history), fit.stopped_early) == (2, 5, True)
