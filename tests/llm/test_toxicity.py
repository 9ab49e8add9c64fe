"""Toxicity: convolution against plain loops, gradient progress, held-out accuracy, thresholds against a scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import toxicity as X


@pytest.fixture(scope="module")
def small():
    texts = [f"word{i} plain text number{i % 7} and more" for i in range(60)] + [f"word{i} you loser{i % 3} text" for i in range(60)]
    return X.fit(texts, [0] * 60 + [1] * 60, epochs=10)


def plain_score(model, text):
    words = X._WORD.findall(text.lower())
    words += [""] * (max(X.WIDTHS) - len(words))
    vectors = [sum(model.embedding[b] for b in X._parts(w)) for w in words]
    z = model.bias
    for w, width in enumerate(X.WIDTHS):
        for f in range(X.FILTERS):
            values = [sum(vectors[i + j] @ model.filters[w][j][:, f] for j in range(width)) + model.biases[w][f] for i in range(len(words) - width + 1)]
            z += max(max(values), 0) * model.out[w * X.FILTERS + f]
    return 1 / (1 + np.exp(-z))


def test_score_against_loops(small, monkeypatch):
    texts = ["", "one", "Some plain words and a loser2 here.", "çà et là " * 30]
    want = [plain_score(small, t) for t in texts]
    assert [X.score(small, t) for t in texts] == pytest.approx(want, abs=1e-4)
    monkeypatch.setattr(X, "_BLOCK", 5)
    assert [X.score(small, t) for t in texts] == pytest.approx(want, abs=1e-4)
    assert X.score(small, None) == X.score(small, "")


def test_forms_of_a_word_share_what_is_learned(small):
    assert X.score(small, "plain loser9 text") > 0.5 > X.score(small, "plain winner9 text")


def test_one_label_only():
    assert X.score(X.fit(["a", "b"], [1, 1]), "c") > 0.9 and X.score(X.fit(["a"], [0]), "c") < 0.1
    assert X.score(X.fit([], []), "c") == 0.5


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = X.train(docs, labels.filter(fold != 0))
    held = X.apply(docs.join(labels, "doc_id").filter(fold == 0).select("doc_id", "text", "toxic"), model).toPandas()
    assert ((held["score"] >= 0.5) == (held["predicted"] == 1)).all() and held["score"].between(0, 1).all()
    hit = held["predicted"] == held["toxic"]
    assert hit.mean() > 0.97 and hit[held["toxic"] == 1].mean() > 0.9


def test_thresholds_against_a_scan(spark):
    rng = np.random.default_rng(3)
    rows = [(lang, float(np.clip(rng.normal(0.3 + 0.3 * y, 0.2), 0, 1)), int(y)) for lang in ("a", None) for y in rng.integers(0, 2, 200)]
    rows += [("only", 0.5, 1), ("b", 1.0, 1), ("b", 0.0, 0), ("b", 0.7, None)]
    got = {r["lang"]: r["threshold"] for r in X.thresholds(spark.createDataFrame(rows, "lang string, score double, y int"), "lang", "y", 50).collect()}
    assert set(got) == {"a", "b", None}
    for lang, threshold in got.items():
        def f1(t):
            own = [(min(int(s * 50), 49), y) for n, s, y in rows if n == lang and y is not None]
            p, n = (sum(y == k and c >= t for c, y in own) for k in (1, 0))
            return 2 * p / (p + n + sum(y for _, y in own))
        best = max(range(1, 50), key=lambda t: (round(f1(t), 9), -abs(t / 50 - 0.5), t))
        assert threshold == pytest.approx(best / 50)


def test_awkward_rows(odd, nothing, small):
    out = X.apply(odd, small)
    assert out.columns == [*odd.columns, "predicted"] and out.count() == odd.count()
    assert X.apply(nothing, small).count() == 0
    trained = X.train(odd, odd.select("doc_id", F.when(F.col("pos") % 3 < 2, F.col("pos") % 2).alias("toxic"), "text"))
    assert 0 <= X.score(trained, "anything") <= 1
    assert X.score(X.train(nothing, nothing.withColumn("toxic", F.lit(1))), "x") == 0.5


def test_a_class_of_long_texts_is_learned(spark):
    clean = [(i, f"a quiet walk by the river number {i} with friends and bread", 0) for i in range(60)]
    bad = [(100 + i, "horrid worthless vile words again and again " * 400, 1) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in clean + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in clean + bad], "doc_id long, toxic int")
    assert len(bad[0][1]) > X.SAMPLE_CHARS
    model = X.train(docs, labels)
    # Before, no long text reached the fit and everything scored 0.002.
    assert all(X.score(model, t) > 0.5 for _, t, _ in bad) and all(X.score(model, t) < 0.5 for _, t, _ in clean)
