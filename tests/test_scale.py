"""Skew-safe ordered computations against pandas, with the huge-group path forced."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankweave import scale
from rankweave.operators import audits, diagnostics, pools


def skewed(seed=0):
    """One group with a third of all rows, one with few distinct values, many small ones."""
    rng = np.random.default_rng(seed)
    keys = np.concatenate([np.full(400, 1), np.full(200, 2), rng.integers(3, 60, 600)])
    value = np.round(rng.normal(size=len(keys)), 3)
    value[keys == 2] = rng.integers(0, 3, (keys == 2).sum())
    return pd.DataFrame({"k": keys, "v": value, "i": rng.permutation(len(keys))})


def test_the_huge_path_is_taken(hot):
    df = hot.createDataFrame(skewed())
    assert scale.hot_limit(df, ["k"]) == 40
    plan = scale.ranked(df, ["k"], [F.col("v"), F.col("i")])._jdf.queryExecution().toString()
    assert "_piece" in plan


def test_small_input_uses_a_plain_window(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    assert scale.hot_limit(df, ["k"]) is None


@pytest.mark.parametrize("keys", [["k"], []])
def test_rank_and_size(hot, keys):
    frame = skewed()
    got = scale.ranked(hot.createDataFrame(frame), keys, [-F.col("v"), F.col("i")], "r", "n").toPandas()
    frame["g"] = frame["k"] if keys else 0
    want = frame.sort_values(["v", "i"], ascending=[False, True])
    want["r"] = want.groupby("g").cumcount() + 1
    want["n"] = want.groupby("g")["v"].transform("size")
    merged = got.merge(want, on="i", suffixes=("", "_want"))
    assert (merged["r"] == merged["r_want"]).all() and (merged["n"] == merged["n_want"]).all()


def test_running_aggregates(hot):
    frame = skewed(1)
    got = scale.running(hot.createDataFrame(frame), ["k"], [F.col("i")], {
        "s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v"))}).toPandas().sort_values("i")
    want = frame.sort_values("i")
    groups = want.groupby("k")["v"]
    for name, series in (("s", groups.cumsum()), ("hi", groups.cummax()), ("lo", groups.cummin())):
        assert np.allclose(got[name].to_numpy(), series.to_numpy()), name


def test_average_ranks(hot):
    frame = skewed(2)
    got = scale.midranked(hot.createDataFrame(frame), ["k"], F.col("v"), "m", "n").toPandas().sort_values("i")
    want = frame.sort_values("i").groupby("k")["v"].rank(method="average")
    assert np.allclose(got["m"].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles(hot, keys):
    frame = skewed(3)
    got = scale.quantiles(hot.createDataFrame(frame), keys, "v", [0.0, 0.25, 0.5, 0.9, 1.0], "q").toPandas()
    for row in got.itertuples():
        values = frame.loc[frame["k"] == row.k, "v"] if keys else frame["v"]
        assert np.allclose(row.q, np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0]))


def with_nulls(seed=4):
    """As ``skewed``, with a huge group under a null key and null values in every group."""
    frame = skewed(seed)
    keys = frame["k"].astype("Int64").mask(frame["k"] == 1)
    values = frame["v"].mask(frame["i"] % 7 == 0)
    return [(None if pd.isna(k) else int(k), None if pd.isna(v) else float(v), int(i)) for k, v, i in zip(keys, values, frame["i"])]


@pytest.mark.parametrize("keys", [["k"], []])
def test_nulls_give_the_same_on_both_paths(hot, keys):
    df = hot.createDataFrame(with_nulls(), "k long, v double, i long")

    def answers():
        order = [F.col("v").isNull().cast("int"), F.col("v"), F.col("i")]
        found = [scale.ranked(df, keys, order, "r", "n"), scale.midranked(df, keys, F.col("v"), "m", "n"),
                 scale.running(df, keys, [F.col("i")], {"s": ("sum", F.col("v")), "c": ("count", F.lit(1))}, "n"),
                 scale.quantiles(df, keys, "v", [0.1, 0.5, 1.0], "q")]
        return [sorted(str([round(x, 9) if isinstance(x, float) else x for x in (list(r["q"]) if "q" in r else r)] + ([r["k"]] if "k" in r else []))
                       for r in one.select(*sorted(one.columns)).collect()) for one in found]

    cut = answers()
    hot.conf.set("spark.rankweave.hotGroupRows", "1000000")
    assert cut == answers()
    assert all(len(rows) == df.count() for rows in cut[:3])


def test_a_plan_that_multiplies_rows_is_never_small(spark):
    few = spark.range(100)
    assert scale.is_small(few) and not scale.is_small(few.select(F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("x")))


def test_passes_over_a_huge_group_do_not_repeat_what_comes_before(hot):
    """The plan of the last pass starts from written rows, not from the input."""
    df = hot.range(500).select((F.col("id") % 2).alias("k"), (F.col("id") * 7 % 97).cast("double").alias("v"), "id")
    made = [scale.running(df, ["k"], [F.col("id")], {"s": ("sum", F.col("v"))}), scale.midranked(df, ["k"], F.col("v"), "m"),
            scale.quantiles(df, ["k"], "v", [0.5], "q")]
    assert all("Range (" not in one._jdf.queryExecution().optimizedPlan().toString() for one in made)


def test_many_pieces_are_joined_instead_of_broadcast(hot, monkeypatch):
    monkeypatch.setattr(scale, "BROADCAST_PIECES", 0)
    test_rank_and_size(hot, ["k"])


def test_next_value_across_blocks(spark):
    df = spark.range(1, 101).select(F.lit("a").alias("k"), F.col("id").alias("r"), (F.col("id") * 2).alias("v"))
    got = scale.following(df, ["k"], "r", {"nxt": "v"}, block=7).toPandas().sort_values("r")
    assert len(got) == 100
    assert got["nxt"].tolist()[:-1] == [2 * i for i in range(2, 101)] and np.isnan(got["nxt"].iloc[-1])


def test_list_order_and_adjustment_on_a_huge_group(hot):
    frame = pd.DataFrame({"query_id": [1] * 300 + [2] * 5, "cand_key": range(305), "prior": np.arange(305) % 17 * 1.0,
                          "line_no": range(305)})
    ordered = pools.full_list(pools.dedupe(hot.createDataFrame(frame))).toPandas()
    want = frame.sort_values(["query_id", "prior", "line_no"], ascending=[True, False, True])
    want["rank"] = want.groupby("query_id").cumcount() + 1
    merged = ordered.merge(want, on=["query_id", "cand_key"], suffixes=("", "_w"))
    assert (merged["rank"] == merged["rank_w"]).all()
    assert audits.contiguity(hot.createDataFrame(ordered[["query_id", "rank"]])).filter("contiguous").count() == 2

    tests = pd.DataFrame({"f": 1, "i": range(200), "p_value": np.linspace(0.0001, 0.9, 200) ** 2})
    got = diagnostics.benjamini_hochberg(hot.createDataFrame(tests), ["f"], ["i"]).toPandas().sort_values("i")
    p = tests["p_value"].to_numpy()
    scaled = p * len(p) / np.arange(1, len(p) + 1)
    assert np.allclose(got["p_bh"], np.minimum(np.minimum.accumulate(scaled[::-1])[::-1], 1))


def test_rows_are_worked_out_once(hot):
    """The count of groups and the ranking read rows written once, they do not each repeat what comes before."""
    seen = hot.sparkContext.accumulator(0)

    @F.udf("long")
    def noted(value):
        seen.add(1)
        return value

    rows = hot.range(300, numPartitions=3).select((noted("id") % 30).alias("k"), F.col("id").alias("v"))
    for make in (lambda: scale.ranked(rows, ["k"], [F.col("v")]), lambda: scale.midranked(rows, ["k"], F.col("v"), "r"),
                 lambda: scale.quantiles(rows, ["k"], "v", [0.5], "q")):
        before = seen.value
        assert len(make().collect()) in (30, 300)
        assert seen.value - before == 300


def test_columns_turned_into_rows_are_not_written_again(hot, tmp_path):
    """A table read as several rows per row is read again by every pass; writing those rows would take several times its size."""
    path = f"{tmp_path}/wide"
    hot.range(300).selectExpr("id", "id * 0.5 AS a", "cast(id % 7 AS double) AS b", "IF(id % 3 = 0, NULL, -id * 1.0D) AS c").selectExpr(
        "id", "cast(a AS double) AS a", "b", "c").write.parquet(path)
    rows = hot.read.parquet(path).unpivot(["id"], ["a", "b", "c"], "feature", "value")
    assert scale.settled(rows)[1] is False
    got = {r["feature"]: r["q"] for r in scale.quantiles(rows, ["feature"], "value", [0.25, 0.5], "q").collect()}
    frame = hot.read.parquet(path).toPandas()
    assert got == {c: pytest.approx(frame[c].dropna().quantile([0.25, 0.5]).tolist()) for c in ("a", "b", "c")}
