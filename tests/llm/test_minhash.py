"""MinHash: signatures against plain permutations, the edited text, neighbours in order, classes against all pairs."""

import hashlib

import numpy as np

from rankweave.llm import minhash as M


def runs(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_signature_against_plain_permutations():
    made = M.shingles("a b c d e f g h a b c d e f")
    small = [int(x) >> 32 for x in made]
    want = [min((h * int(f) + int(s)) % (1 << 32) for h in small) for f, s in zip(M._FACTORS, M._SHIFTS)]
    assert M.signature(made).tolist() == want
    assert len(set(made.tolist())) == len(runs("a b c d e f g h a b c d e f"))


def test_likeness_estimates_overlap():
    words = [f"w{i}" for i in range(600)]
    a, b = " ".join(words[:500]), " ".join(words[100:])
    x, y = runs(a), runs(b)
    close = M.likeness(M.signature(M.shingles(a)), M.signature(M.shingles(b)))
    assert abs(close - len(x & y) / len(x | y)) < 0.2
    assert M.likeness(M.signature(M.shingles("")), M.signature(M.shingles(None))) == 1.0


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (name, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 4
        changed = text[:len(text) - k] + after[:k]
        marks = [M.signature(M.shingles(t)) for t in (text, changed, after)]
        out.append((name, len(text), hashlib.sha256(changed.encode()).hexdigest(), *[m.astype(">u4").tobytes().hex() for m in marks[:2]],
                    float((marks[0] == marks[1]).mean()), float((marks[0] == marks[2]).mean())))
    return out


def test_neighbours_in_order(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    rows += [(-5, None), (10_000, ""), (20_000, "x"), (None, "first of all, by rule")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r)[:7] for r in M.compare_with_next(docs, M.near_duplicates(docs)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    one = spark.createDataFrame([(3, "only one")], "doc_id long, text string")
    assert [tuple(r)[:7] for r in M.compare_with_next(one, M.near_duplicates(one)).collect()] == brute([(3, "only one")])


def test_classes_against_all_pairs(spark, documents):
    rows = [(r["doc_id"], runs(r["text"])) for r in documents.select("doc_id", "text").collect()]
    parent = {n: n for n, _ in rows}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if (not x and not y) or (x and y and len(x & y) >= 0.8 * len(x | y)):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    want = {n: find(n) for n, _ in rows}
    found = {r["id"]: r["class_id"] for r in M.near_duplicates(documents).collect()}
    got = {n: found.get(n, n) for n in want}
    assert got == want and len(set(want.values())) < len(want)


def test_awkward_rows(odd, nothing):
    out = M.compare_with_next(odd, M.near_duplicates(odd)).collect()
    assert len(out) == odd.count()
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] and by_id[1]["class_id"] == by_id[2]["class_id"] == by_id[3]["class_id"] == 1
    assert by_id[4]["class_id"] == by_id[5]["class_id"] == by_id[6]["class_id"] == 4 and by_id[None]["class_id"] is None
    assert M.compare_with_next(nothing, M.near_duplicates(nothing)).count() == 0


def wanted(rows):
    """Classes of all pairs that share a band, whatever the bucket."""
    sets = {n: runs(t) for n, t in rows}
    bands = {n: [b.tobytes() for b in M.signature(M.shingles(t)).reshape(M.BANDS, -1)] for n, t in rows}
    root = {n: n for n, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and any(x == y for x, y in zip(bands[a], bands[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {n: lo if r == hi else r for n, r in root.items()}
    return root, bands


def changed(words, rng, n):
    made = list(words)
    for i in range(n):
        made[i * 200 // n + int(rng.integers(0, 200 // n))] = f"new{rng.integers(1 << 30)}"
    return " ".join(made)


def test_links_between_items_that_miss_the_smallest(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(200)]
    decoys = [(i, changed(words, rng, 7)) for i in range(60)]
    rows = [*decoys, (100, changed(words, rng, 1)), (101, changed(words, rng, 1))]
    root, bands = wanted(rows)
    shared = [k for k in range(M.BANDS) if bands[100][k] == bands[101][k]]
    # Every bucket where the two meet has a smaller item that is like neither.
    assert shared and all(any(bands[i][k] == bands[100][k] for i, _ in decoys) for k in shared)
    assert all(len(runs(t) & runs(rows[-1][1])) < 0.8 * len(runs(t) | runs(rows[-1][1])) for _, t in decoys)
    found = {r["id"]: r["class_id"] for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {n: found.get(n, n) for n, _ in rows} == root and found[101] == 100


def test_chains_where_only_matched_items_reach_the_rest(spark, monkeypatch):
    monkeypatch.setattr(M, "_CHUNK", 5)
    rng = np.random.default_rng(8)
    rows, names = [], rng.permutation(1_000)
    for _ in range(6):
        words = [f"w{i}" for i in range(200)]
        for _ in range(12):
            words = changed(words, rng, int(rng.integers(1, 5))).split()
            rows.append((int(names[len(rows)]), " ".join(words)))
    root, _ = wanted(rows)
    found = {r["id"]: r["class_id"] for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {n: found.get(n, n) for n, _ in rows} == root


def test_counters_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for n in (1, 9, 90, 9_000, 90_000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = x[: -(-len(x) * 8 // 10)]
        apart = np.abs(np.frombuffer(M.counters(x), np.uint8).astype(int) - np.frombuffer(M.counters(y), np.uint8)).sum()
        assert M._possible(apart, len(x) + len(y))


def test_words_in_groups_and_pieces(monkeypatch):
    texts = ["", None, " ", "a", "A b", "  a b\tc\nd e f ", "é ü " * 9, "x" * 70_000 + " y " + "x" * 70_001, "ab ba", "ba ab"]
    want = [M.shingles(t).tolist() for t in texts]
    assert [len(w) for w in want] == [len(runs(t)) if t != "é ü " * 9 else 14 for t in texts]
    assert [r.tolist() for r in M.shingles_of(texts)] == want
    assert want[4] == M.shingles("a B").tolist() and want[8] != want[9]
    assert M.shingles("x" * 70_000).tolist() != M.shingles("x" * 69_999 + "y").tolist()
    monkeypatch.setattr(M, "_BYTES", 7)
    assert [r.tolist() for r in M.shingles_of(texts)] == want
    assert [r.tolist() for g in M._in_groups(texts) for r in M.shingles_of(g)] == want
