"""Pfair mixing: windows, lag below one block, whole reading, brute-force schedule."""

import random
from collections import Counter, defaultdict

import pytest

from rankweave.llm import mixing


@pytest.mark.parametrize("seed", range(12))
def test_every_prefix_is_within_one_block(seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.random() ** 3 + 1e-4 for i in range(rng.randint(1, 30))}
    parts = rng.choice([50, 100, 997])
    quota = mixing.shares(weights, parts)
    assert sum(quota.values()) == parts and set(quota) == set(weights)
    done = Counter()
    for slot, (source, k, at, release, deadline) in enumerate(mixing.period(quota)):
        assert at == slot and release <= slot < deadline and k == done[source]
        done[source] += 1
        assert all(abs(done[s] - quota[s] * (slot + 1) / parts) < 1 for s in quota)
    assert done == quota


def test_share_of_tiny_and_zero_weights():
    assert mixing.shares({"a": 1e-9, "b": 1.0, "c": 0.0}, 10) == {"a": 1, "b": 9}
    assert mixing.shares({}, 10) == {}
    with pytest.raises(ValueError):
        mixing.shares({str(i): 1.0 for i in range(11)}, 10)


def brute(sizes, quota, block):
    """(source, epoch, block) per slot until every source has been read once, one slot after another."""
    order = sorted(quota, key=lambda s: (s is None, s or ""))
    parts, done, out = sum(quota.values()), Counter(), []
    blocks = {s: -(-sizes[s] // block) for s in quota}
    while any(done[s] < blocks[s] for s in quota):
        t = len(out)
        ready = [(-(-(done[s] + 1) * parts // quota[s]), i, s) for i, s in enumerate(order) if done[s] * parts // quota[s] <= t]
        s = min(ready)[2]
        out.append((s, done[s] // blocks[s], done[s] % blocks[s]))
        done[s] += 1
    return out


def test_schedule_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "c", None]), "x", 3) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot string, epoch int")
    weights = {"a": 0.4, "b": 0.35, "c": 0.05, None: 0.2}
    got = mixing.schedule(docs, weights, block_rows=4, parts=100).collect()
    sizes = Counter(r[1] for r in rows)
    want = brute(sizes, mixing.shares(weights, 100), 4)
    slots = defaultdict(list)
    for r in got:
        slots[r["slot"]].append((r["source"], r["epoch"], r["block"]))
        assert r["release"] <= r["slot"] < r["deadline"]
    assert sorted(slots) == list(range(len(want)))
    assert all(set(slots[t]) == {want[t]} for t in slots)
    # Whole in every finished epoch, blocks of four (the last of a source may be short).
    assert {r["doc_id"] for r in got if r["epoch"] == 0} == set(range(700))
    assert all(len(v) <= 4 for v in slots.values())
    again = Counter((r["doc_id"], r["epoch"]) for r in got)
    assert max(again.values()) == 1


def test_awkward_rows(odd, nothing):
    out = mixing.schedule(odd)
    assert set(out.columns) == {*odd.columns, "epoch", "block", "release", "deadline"}
    assert sorted(r["pos"] for r in out.filter("epoch = 0").collect()) == list(range(odd.count()))
    mixed = mixing.mixture(odd)
    assert mixed.columns == odd.columns and {r["slot"] for r in mixed.collect()} == set(range(odd.count()))
    assert mixing.schedule(odd, {"a": 1.0}).select("source").distinct().count() == 1
    assert mixing.schedule(nothing).count() == 0 and mixing.mixture(nothing).count() == 0
