"""SimHash: fingerprints bit by bit, components against all pairs, index against brute force."""

import random
import re

import numpy as np
import xxhash

from rankweave.llm import simhash
from rankweave.llm.components import connect


def plain_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    runs = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(items):
    """Smallest id reachable, by comparing all pairs; items are (id, print)."""
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    groups = {}
    for i, (name, _) in enumerate(items):
        groups.setdefault(find(i), []).append(name)
    return [min((n for n in groups[find(i)] if n is not None), default=None) for i in range(len(items))]


def check(docs):
    items = [(r["doc_id"], plain_print(r["text"])) for r in docs.select("doc_id", "text").collect()]
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    want = sorted(((n, f"{p:016x}", c) for (n, p), c in zip(items, components(items))), key=key)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=key)
    assert got == want


def test_whole_table(documents):
    check(documents)


def test_awkward_rows(odd):
    check(odd)


def test_same_hash_as_spark(spark):
    got = spark.sql("select xxhash64('a b c d') h").first()["h"] % (1 << 64)
    assert got == xxhash.xxh64_intdigest(b"a b c d", 42)


def planted(count, seed):
    rng = random.Random(seed)
    prints = []
    for _ in range(count):
        base = rng.getrandbits(64)
        prints.append(base)
        for _ in range(rng.randint(0, 3)):
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                base ^= 1 << bit
            prints.append(base)
    return prints


def test_index_against_all_pairs(spark):
    prints = planted(150, 3)
    # A dense ball: one large bucket takes the breadth-first way.
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(400)]
    prints = sorted(set(prints))
    rows = [(int(np.uint64(p).astype(np.int64)), i) for i, p in enumerate(prints)]
    got = {r["fp"]: r["best"] for r in simhash.classes(spark.createDataFrame(rows, "fp long, best long")).collect()}
    want = components([(i, p) for i, p in enumerate(prints)])
    assert [got[fp] for fp, _ in rows] == want
    made = simhash.links(spark.createDataFrame(rows, "fp long, best long"), "fp").collect()
    assert all((int(r["u"]) ^ int(r["v"])) % (1 << 64) != 0 and bin((int(r["u"]) ^ int(r["v"])) & (2**64 - 1)).count("1") <= 4 for r in made)


def test_connect(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 300) if i % 50 != 49] + [(rng.randrange(400, 500), 400) for _ in range(200)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connect(spark.createDataFrame(chain, "u long, v long"), "u", "v").collect()}
    assert all(got[i] == i // 50 * 50 for i in range(0, 300))
    assert all(root == 400 for node, root in got.items() if node >= 400)
    assert connect(spark.createDataFrame([], "u long, v long"), "u", "v").count() == 0


def test_one_of_each_group_stays(odd):
    items = [(r["doc_id"], r["pos"], plain_print(r["text"])) for r in odd.collect()]
    groups = components([(pos, p) for _, pos, p in items])
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    by_pos = dict(zip([pos for _, pos, _ in items], groups))
    stayed = [r["pos"] for r in kept.collect()]
    # Equal rows are one document; any of them may stay.
    assert sorted(by_pos[p] for p in stayed) == sorted(set(groups))
    assert {1, 7, 8, 11}.issubset({r["doc_id"] for r in kept.collect()})


def test_empty(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.drop_near_duplicates(nothing).count() == 0
