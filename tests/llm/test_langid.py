"""Language identification: automaton against substring search, parse against a greedy loop, held-out accuracy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import langid

SAMPLES = {"aa": ["the cat sat on the mat", "a dog and the cat"], "bb": ["der hund und die katze", "über die straße"]}


@pytest.fixture(scope="module")
def parser():
    return langid.build_parser(SAMPLES)


def symbols(text):
    """Letters in lower case with one gap between runs; a text starts with a letter."""
    out, gap = [], False
    for c in text:
        if c.isalpha():
            if gap and out:
                out.append(" ")
            out.append(c.lower()[0])
            gap = False
        else:
            gap = True
    return out + ([" "] if gap and out else [])


def greedy(text, sample):
    """Phrases of a text, each the longest match in the sample (or one symbol), restarting at every piece."""
    source, total = "".join(sample), 0
    for at in range(0, len(text), langid.PIECE):
        piece, i = text[at:at + langid.PIECE], 0
        while i < len(piece):
            n = 1
            while i + n <= len(piece) and "".join(piece[i:i + n]) in source:
                n += 1
            i += max(1, n - 1)
            total += 1
    return total


def test_parse_against_greedy_loop(parser):
    rng = random.Random(2)
    texts = ["".join(rng.choice("thecaosmdnur  ü,z☃") for _ in range(rng.randint(1, 700))) for _ in range(40)]
    got = langid.parse(parser, texts)
    for text, (language, score) in zip(texts, got):
        own = symbols(text)
        if not own:
            assert (language, score) == ("und", 0.0)
            continue
        cost = {}
        for k, name in enumerate(parser.languages):
            sample = symbols(" ".join(SAMPLES[name]))
            cost[name] = greedy(own, sample) * parser.bits[k] / len(own)
        best = min(sorted(cost), key=cost.get)
        rival = min(v for n, v in cost.items() if n != best)
        assert language == best and score == pytest.approx(rival / (rival + cost[best]))


def test_automaton_holds_every_substring(parser):
    sample = [3, 4, 3, 4, 4, 5, 0, 3, 4, 5]
    steps = langid._automaton(sample, 7)
    whole = {tuple(sample[i:j]) for i in range(len(sample)) for j in range(i, len(sample) + 1)}
    rng = np.random.default_rng(1)
    for _ in range(500):
        word = tuple(rng.choice([0, 3, 4, 5, 6], rng.integers(1, 5)))
        state, ends = 0, False
        for s in word:
            state = steps[state * 7 + s]
            if state < 0:
                ends = True
                break
            ends = state == langid._SINK or ends
        assert ends != (word in whole)


def test_no_letters_and_ties():
    parser = langid.build_parser({"b": ["same text"], "a": ["same text"]})
    assert langid.parse(parser, [None, "", "123 ?!", "same text"]) == [("und", 0.0)] * 3 + [("a", 0.5)]
    assert parser.bits[0] == pytest.approx(math.log2(len("same text") + 2))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    parser = langid.train(docs.filter(fold != 2))
    out = langid.identify(docs.filter(fold == 2), parser).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert out[0] > 0.97 and 0 <= out[1] <= out[2] <= 1


def test_awkward_rows(odd, nothing):
    parser = langid.train(odd)
    assert parser.languages == ["de", "en", "fr"]
    out = langid.identify(odd, parser)
    assert out.columns == [*odd.columns, "lang_pred"] and out.count() == odd.count()
    rows = {r["pos"]: r for r in out.collect()}
    assert all(rows[p]["lang_pred"] == "und" and rows[p]["score"] == 0 for p in (3, 4, 5, 9, 10, 12))
    assert rows[6]["lang_pred"] == "de"
    assert langid.identify(nothing, parser).count() == 0
    none = langid.identify(odd, langid.train(nothing))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_languages_of_one_large_script_and_of_a_rare_one():
    rng = random.Random(6)
    # Two languages of 600 common Han letters each in words of two, a rare pair in Cyrillic, and much text in 130 Ethiopic letters.
    han = [chr(0x4E00 + i) for i in range(1_200)]
    ethiopic = [c for c in map(chr, range(0x1200, 0x1300)) if c.isalpha()][:130]
    words = {"h1": ["".join(rng.sample(han[:600], 2)) for _ in range(400)], "h2": ["".join(rng.sample(han[600:], 2)) for _ in range(400)],
             "ru": ["".join(rng.choices("абвгдежз", k=5)) for _ in range(60)], "uk": ["".join(rng.choices("иклмнопр", k=5)) for _ in range(60)],
             "xx": ["".join(rng.choices(ethiopic, k=5)) for _ in range(400)]}
    text = lambda name, n: " ".join(rng.choices(words[name], k=n))
    sizes = {"h1": 3_000, "h2": 3_000, "ru": 40, "uk": 40, "xx": 4_000}
    parser = langid.build_parser({name: [text(name, n)] for name, n in sizes.items()})
    names = [name for name in words for _ in range(20)]
    got = langid.parse(parser, [text(name, 30) for name in names])
    assert [language for language, _ in got] == names


def test_edges_answer_as_the_table(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("thecaosmdnur  ü,z☃") for _ in range(rng.randint(0, 700))) for _ in range(40)]
    want = langid.parse(langid.build_parser(SAMPLES), texts)
    monkeypatch.setattr(langid, "_DENSE", 0)
    sparse = langid.build_parser(SAMPLES)
    assert all(isinstance(s, langid.Edges) for s in sparse.steps) and langid.parse(sparse, texts) == want
