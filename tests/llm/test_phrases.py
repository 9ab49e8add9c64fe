import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankweave.llm import phrases, queries


def plainly(rows, least, top):
    """All counts by enumeration."""
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        longest = Counter()
        for g, a in often.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    longest[g[i:i + k]] = max(longest[g[i:i + k]], a)
        ranked = []
        for g, a in often.items():
            if 100 * longest[g] >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            ranked.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i, g.decode(), -a, l, r, total[lang], -s) for i, (s, a, g, l, r) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def made(seed, size, vocabulary):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "漢字", "a|b", "X"]
    rows = []
    for i in range(size):
        body = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]) for _ in range(rng.randint(0, 60)))
        if i % 3 == 0:
            body += " the long repeated passage of many plain words that goes on and on"
        rows.append((rng.choice(["en", "de", None]), body))
    return rows + [("en", None), ("fr", ""), (None, "..."), ("xx", "a a a a a a a a a a b a b a b a b")]


@pytest.mark.parametrize("seed, size, vocabulary, least, top, block", [
    (1, 120, 6, 3, 2_000, 100), (2, 60, 3, 2, 25, 40), (3, 150, 30, 4, 2_000, phrases.BLOCK_WORDS), (4, 40, 2, 1, 2_000, 300)])
def test_against_enumeration(spark, monkeypatch, seed, size, vocabulary, least, top, block):
    monkeypatch.setattr(phrases, "SHARE_WORDS", 500)
    rows = made(seed, size, vocabulary)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert found(phrases.collocations(docs, least=least, top=top, block_words=block)) == plainly(rows, least, top)


def test_counts_and_paths(spark):
    rows = [("en", "p q r s t u v. q r s t u z")] * 3 + [("en", "m n m n m n m n")] * 2
    parts = phrases.graph(spark.createDataFrame(rows, "lang string, text string"), least=2)
    word = {r["a"]: r["word"] for r in parts["words"].collect()}
    assert {r["word"]: r["n"] for r in parts["words"].collect()} == {**dict.fromkeys("qrstu", 6), **dict.fromkeys("pvz", 3), **dict.fromkeys("mn", 8)}
    assert {word[r["a"]] + word[r["b"]]: r["n"] for r in parts["pairs"].collect()} == {
        "pq": 3, "qr": 6, "rs": 6, "st": 6, "tu": 6, "uv": 3, "uz": 3, "mn": 8, "nm": 6}
    paths = {"".join(word[w] for w in r["words"]): (list(r["weights"]), list(r["flows"])) for r in phrases.compact(parts["edges"], parts["nodes"]).collect()}
    assert paths.pop("pqrs", None) is None
    assert paths.pop("pqrstu") == ([3, 6, 6], [3, 6, 6, 6]) and paths.pop("stuv") == ([3], [6, 3]) and paths.pop("stuz") == ([3], [6, 3])
    assert paths == {"mnmn": ([6], [6, 6]), "nmnm": ([4], [6, 6])}


def test_long_path(spark):
    text = " ".join(f"w{i}" for i in range(1_500))
    parts = phrases.graph(spark.createDataFrame([("en", text)] * 2, "lang string, text string"), least=2)
    paths = phrases.compact(parts["edges"], parts["nodes"]).collect()
    assert len(paths) == 1 and len(paths[0]["words"]) == 1_500 and set(paths[0]["weights"]) == {2}


def test_odd_rows(odd, nothing):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert found(phrases.collocations(odd, least=2)) == plainly(rows, 2, 2_000)
    assert found(phrases.collocations(nothing)) == []


def test_scores_beyond_64_bits(spark):
    big = 2**62 + 1
    row = spark.range(1).select(phrases._lowest(F.lit(big), [(F.lit(2**63 - 1), F.lit(big)), (F.lit(big), F.lit(big))]).alias("c")).first()["c"]
    assert (row["score"], row["k"]) == (2_000_000 * big // (2**63 - 1 + big), 1)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert found(queries.op12_phrases(spark, folder)) == plainly(rows, 30, 2_000)
