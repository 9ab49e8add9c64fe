"""Scalar functions, diagnostics, features and pairs on hand values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankweave.functions import keys as K
from rankweave.functions import scores as S
from rankweave.operators import diagnostics as D
from rankweave.operators import features as FE
from rankweave.operators import metrics as M
from rankweave.operators import pairs as X
from rankweave.scale import midranked


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column).first()[0]


@pytest.mark.parametrize("text,want", [("b.a", "a.b"), (" b . . a ", "a.b"), ("a.a", "a.a"), ("", None), (" . ", None)])
def test_set_key(spark, text, want):
    assert one(spark, K.set_key("t"), t=text) == want


def test_invalid_token_is_null_or_kept(spark):
    assert one(spark, K.set_key("t", K.letters_only), t="A.--") is None
    assert one(spark, K.set_key("t", K.letters_only, keep_invalid=True), t="A.--") == "--.a"
    assert one(spark, K.same_up_to_case("t", F.lower("t")), t="A.b") is True


def test_structured_text(spark):
    assert one(spark, K.split_structured("t")["right"], t="a>b>c") == "c"
    assert one(spark, K.split_structured("t"), t="a>c") is None
    assert [one(spark, K.tagged_class("t"), t=f"<RX_{n}> x") for n in ("3", "10", "11", "x")] == [3, 10, None, None]


def test_listed_tokens_are_never_all_removed(spark):
    assert one(spark, K.drop_listed(K.tokens("t"), ["a"]), t="a.b") == ["b"]
    assert one(spark, K.drop_listed(K.tokens("t"), ["a"]), t="a.a") == ["a", "a"]
    assert one(spark, K.removal_status(K.tokens("t"), ["a"]), t="a.b") == "changed"


@pytest.mark.parametrize("ref,new,want", [(1.0, 1.0 + 9e-7, True), (1.0, 1.0 + 2e-6, False), (0.0, 9e-9, True), (1.0, math.inf, False),
                                          (math.nan, 1.0, False)])
def test_tolerance(spark, ref, new, want):
    assert one(spark, S.within_tolerance(F.lit(ref), F.lit(new))) is want


def test_float32_steps(spark):
    rows = [(1.0, 1.0), (1.0, float(np.nextafter(np.float32(1), np.float32(2)))), (0.0, -0.0), (1e39, 1.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a DOUBLE, b DOUBLE").select(S.float32_steps("a", "b")).collect()]
    assert got == [0, 1, 0, None]


def test_bins_hold_every_value(spark):
    rows = spark.range(1, 11).select(S.length_bin(F.col("id")).alias("l"), S.rank_bin(F.col("id")).alias("r")).collect()
    assert [r["l"] for r in rows] == ["1", "2-3", "2-3", "4-6", "4-6", "4-6", "7-9", "7-9", "7-9", "10"]
    assert [r["r"] for r in rows] == ["1", "2", "3", "4-5", "4-5"] + ["6-10"] * 5
    for value in (0, 11):
        with pytest.raises(Exception, match="out of range"):
            spark.range(1).select(S.length_bin(F.lit(value))).collect()


def test_midrank_scores(spark):
    groups = {"x": [3.0, 7.0, 7.0, 7.0, -2.0, 3.0], "y": [0.25], "z": [6.0, 6.0]}
    rows = spark.createDataFrame([(q, p) for q, values in groups.items() for p in values], "q STRING, p DOUBLE")
    ranks = midranked(rows, ["q"], F.col("p"), "m", "n")
    got = sorted((r[0], r[1]) for r in ranks.select("q", S.normalised_midrank(F.col("m"), F.col("n")).alias("s")).collect())

    def brute(p, values):
        place = sum(v < p for v in values) + (sum(v == p for v in values) + 1) / 2
        return (place - 1) / (len(values) - 1) if len(values) > 1 else 1.0

    want = sorted((q, brute(p, values)) for q, values in groups.items() for p in values)
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_negative_log_prior_is_an_error(spark):
    with pytest.raises(Exception, match="negative prior"):
        spark.range(1).select(S.log_prior(F.lit(-1.0))).collect()


def test_loss_does_not_overflow(spark):
    assert one(spark, S.pair_loss(F.lit(-1e6), F.lit(1e6))) == pytest.approx(2e6)
    assert one(spark, S.pair_loss(F.lit(1.0), F.lit(1.0))) == pytest.approx(math.log(2))


def test_rank_zero_scores_zero(spark):
    assert [one(spark, S.rank_metric(F.lit(r), m)) for r, m in ((0, "top1"), (0, "mrr"), (2, "mrr"), (2, "top1"), (3, "top3"))] == [0, 0, 0.5, 0, 1]


def test_holm_and_step_up(spark):
    p = [0.2, 0.005, 0.05, 0.0125, 0.05, 0.9]
    order = sorted(range(len(p)), key=lambda i: (p[i], i))
    down, up, high, low = [0.0] * len(p), [0.0] * len(p), 0.0, 1.0
    for k, i in enumerate(order):
        high = down[i] = max(high, min(1.0, p[i] * (len(p) - k)))
    for k, i in reversed(list(enumerate(order))):
        low = up[i] = min(low, p[i] * len(p) / (k + 1))
    rows = spark.createDataFrame(list(enumerate(p)), "i INT, p_value DOUBLE")
    assert [r["p_holm"] for r in D.holm(rows, [], ["i"]).orderBy("i").collect()] == pytest.approx(down)
    assert [r["p_bh"] for r in D.benjamini_hochberg(rows, [], ["i"]).orderBy("i").collect()] == pytest.approx(up)


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id LONG, cand_key STRING, prior DOUBLE, rank LONG, n LONG, v DOUBLE")


def test_descriptors_of_a_reordered_list(spark):
    ref = lists(spark, [(1, "A", 0.6, 1, 3, 0.1), (1, "B", 0.3, 2, 3, 0.2), (1, "C", 0.1, 3, 3, 0.4)])
    cur = lists(spark, [(1, "B", 0.6, 1, 3, 0.2), (1, "A", 0.3, 2, 3, 0.1), (1, "C", 0.1, 3, 3, 0.4)])
    truth = spark.createDataFrame([(1, "A")], "query_id LONG, truth_key STRING")
    row = D.list_descriptors(cur, ref, truth, lambda a, b: 1 - F.abs(a - b), lambda a, b: F.abs(a - b), "v").first()
    assert (row["length"], row["jaccard"], row["shared"]) == (3, 1.0, 3)
    assert row["kendall"] == pytest.approx(1 / 3) and 0 < row["entropy"] < 1
    assert row["pair_distance"] == pytest.approx(0.2) and row["near_miss"] == pytest.approx(0.9)


def test_undefined_is_null_not_zero(spark):
    single = lists(spark, [(1, "A", 1.0, 1, 1, 0.1)])
    zero = lists(spark, [(1, "A", 0.0, 1, 2, 0.1), (1, "B", 0.0, 2, 2, 0.1)])
    assert D.normalised_entropy(single, ["query_id"]).first()["entropy"] is None
    assert D.normalised_entropy(zero, ["query_id"]).first()["entropy"] is None
    assert D.order_concordance(single, single).first()["kendall"] is None
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x DOUBLE, y DOUBLE")
    assert D.correlation(flat, [], "x", "y").first()["correlation"] is None
    assert D.correlation(flat, [], "x", "y", True).first()["correlation"] is None
    assert D.quartile_effects(flat, [], "x", "y").count() == 0


def test_gap_groups(spark):
    priors = [[1.0], [1.0, 1.0], [1.0, 0.75], [1.0, 0.5], [1.0, 0.25], [1.0, 0.0]]
    rows = [(q, str(i), p, i + 1, len(ps), 0.0) for q, ps in enumerate(priors) for i, p in enumerate(ps)]
    got = [r["gap_group"] for r in D.gap_groups(lists(spark, rows)).orderBy("query_id").collect()]
    assert got == [-1, 0, 0, 1, 2, 3]
    equal = [(q, str(i), p, i + 1, 2, 0.0) for q in range(8) for i, p in enumerate([1.0, 0.5])]
    assert {r["gap_group"] for r in D.gap_groups(lists(spark, equal)).collect()} == {0}


def test_headroom_null_without_room(spark):
    df = spark.createDataFrame([(0.75, 0.05), (1.0, 0.0)], "b DOUBLE, e DOUBLE")
    got = [r[0] for r in df.select(M.headroom(df, "b", "e")).collect()]
    assert got[0] == pytest.approx(0.2) and got[1] is None


def test_selection_ties_go_to_lowest_index(spark):
    trials = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7 + 1e-13), (3, 0.7)], "config INT, mean DOUBLE")
    assert X.convergence_choice(trials).first()["config"] == 1


def test_distribution_of_nothing(spark):
    empty = spark.createDataFrame([], "v DOUBLE")
    row = D.distribution(empty, [], "v").first()
    assert row["n"] == 0 and row["mean"] is None and row["q500"] is None


def test_variation_undefined_for_tiny_mean(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0), (1e-9, -1e-9, 0.0)], "v_1 DOUBLE, v_2 DOUBLE, v_3 DOUBLE")
    got = [r[0] for r in rows.select(D.variation(rows, [1, 2, 3])).collect()]
    assert got[0] == pytest.approx(0.5) and got[1] is None


def test_averaging_rejects_changed_columns(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0), (1, 3.0, 6.0)], "k INT, a DOUBLE, f DOUBLE")
    with pytest.raises(Exception, match="differs"):
        D.average_replicates(rows, ["k"], ["a"], ["f"]).collect()


def test_vector_sets_against_numpy(spark):
    g = np.random.default_rng(0)
    sets = {0: g.normal(size=(7, 4)), 1: g.normal(size=(11, 4))}
    rows = [(o, i, [float(x) for x in v]) for o, m in sets.items() for i, v in enumerate(m)]
    vectors = spark.createDataFrame(rows, "owner INT, pos LONG, vec ARRAY<DOUBLE>")
    pairs = spark.createDataFrame([(0, 1), (0, 9)], "left INT, right INT")
    got = {r["right"]: r["similarity"] for r in FE.set_similarity(pairs, FE.unit(vectors), block=3).collect()}
    unit = {o: m / np.linalg.norm(m, axis=1, keepdims=True) for o, m in sets.items()}
    cosine = unit[0] @ unit[1].T
    assert got[1] == pytest.approx((cosine.max(1).mean() + cosine.max(0).mean()) / 2) and got[9] == 0.0


def test_missing_fragments_give_one_zero_vector(spark):
    owners = spark.createDataFrame([(1, ["a", "x"]), (2, ["x"])], "id INT, fragments ARRAY<STRING>")
    vectors = spark.createDataFrame([("a", 0, [1.0, 2.0])], "fragment STRING, pos INT, vec ARRAY<FLOAT>")
    owners = owners.withColumn("fragments", F.col("fragments"))
    rows = FE.combine_vectors(owners, vectors.withColumn("fragment", F.col("fragment")), "id", 2)
    got = {r["id"]: list(r["vec"]) for r in rows.select("id", "vec").collect()}
    assert got == {1: [1.0, 2.0], 2: [0.0, 0.0]}


def test_schema_mapping_rejects_wrong_flags(spark):
    rows = spark.createDataFrame([(1, "a", 0.5, 0.0, 1.0)], "query_id INT, cand_key STRING, prior DOUBLE, source_a DOUBLE, source_b DOUBLE")
    with pytest.raises(Exception, match="unexpected source flag"):
        FE.drop_flags(rows).collect()
    with pytest.raises(ValueError):
        FE.add_flags(rows, 1.0, 0.0)


def labelled(spark, pos, neg):
    rows = [(1, i, i + 1, i < pos) for i in range(pos + neg)]
    return spark.createDataFrame(rows, "query_id INT, cand_key INT, rank INT, is_match BOOLEAN")


@pytest.mark.parametrize("mining", ["random", "mixed"])
def test_pairs_are_distinct_and_complete(spark, mining):
    got = X.training_pairs(labelled(spark, 3, 8), 1, 5, mining=mining).toPandas()
    assert got.groupby("pos_key").size().tolist() == [5, 5, 5] and not got.duplicated().any()
    assert set(got["neg_key"]) <= set(range(3, 11))
    if mining == "mixed":
        assert all({3, 4} <= set(g) for _, g in got.groupby("pos_key")["neg_key"])
    few = X.training_pairs(labelled(spark, 1, 2), 1, 5, mining=mining).toPandas()
    assert sorted(few["neg_key"]) == [1, 2]
    assert X.training_pairs(labelled(spark, 0, 4), 1, 5, mining=mining).count() == 0


def test_split_keeps_queries_whole(spark):
    rows = spark.createDataFrame([(q, c, c == 0) for q in range(50) for c in range(3)], "query_id LONG, cand_key INT, is_match BOOLEAN")
    parts = X.query_split(rows, 0.8, 3).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 40, "eval": 10}


def test_fitted_ranker_finds_the_useful_feature(spark):
    g = np.random.default_rng(1)
    frame = pd.DataFrame({"pos_a": g.normal(1, 1, 400), "neg_a": g.normal(0, 1, 400), "pos_b": g.normal(size=400), "neg_b": g.normal(size=400)})
    w = X.fit_pairwise_ranker(spark.createDataFrame(frame), ["a", "b"])
    d = frame[["pos_a", "pos_b"]].to_numpy() - frame[["neg_a", "neg_b"]].to_numpy()
    x = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(d @ x))
        x += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d, d.T @ p)
    assert (w["a"], w["b"]) == pytest.approx(tuple(x), abs=1e-3)


def test_logit_recovers_coefficients(spark):
    g = np.random.default_rng(2)
    x, c = g.normal(size=3000), g.integers(0, 2, 3000)
    y = g.random(3000) < 1 / (1 + np.exp(-(0.5 + 1.0 * x - 0.7 * c)))
    frame = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "k": 1.0, "c": np.where(c, "b", "a")}))
    got = {r["term"]: r["coefficient"] for r in X.fit_logit(frame, "y", ["x", "k"], "c").collect()}
    assert set(got) == {"intercept", "x", "c=b"}
    assert got["x"] == pytest.approx(1.0, abs=0.15) and got["c=b"] == pytest.approx(-0.7, abs=0.25)
