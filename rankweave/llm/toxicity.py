"""Toxicity scores from a convolutional text classifier.

Words are hashed to embeddings, and so are their beginnings, so that inflected forms share what is
learned of one another; filters one, two and three words wide run over the whole text, and the
largest value of each filter goes to a logistic output.  All of it is trained in numpy on a bounded
sample.  Scoring a text costs one pass over its words, whatever its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import labelled_sample, pack, unpack

# The documented bounds of the sample: rows of each label, and characters read of a text.
SAMPLE_ROWS = 2_500
SAMPLE_CHARS = 12_000
BUCKETS = 1 << 18
DIMENSION = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
# Letters of the beginnings of a word that have an embedding of their own.
BEGINNINGS = (4, 5, 6)
EPOCHS = 8
_RATE, _BATCH, _DECAY = 0.02, 64, 1e-5
_WORD = re.compile(r"\w+")
_CACHED = 400_000
# Words of one block of a forward pass; blocks overlap by the widest filter.
_BLOCK = 1 << 16


@dataclass
class Classifier:
    """Embeddings, filters per width (width, DIMENSION, FILTERS) with biases, output weights and bias."""
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float


_known: dict[str, tuple[int, ...]] = {}


def _bucket(part: str) -> int:
    return 1 + xxhash.xxh64_intdigest(part.encode("utf-8", "replace")) % (BUCKETS - 1)


def _parts(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings; bucket 0 stands for nothing."""
    if (found := _known.get(word)) is None:
        if len(_known) > _CACHED:
            _known.clear()
        found = (_bucket(word), *[_bucket(word[:n] + "-") if len(word) > n else 0 for n in BEGINNINGS]) if word else (0,) * (1 + len(BEGINNINGS))
        _known[word] = found
    return found


def word_buckets(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each distinct word of the lower-cased text, and the text as places in that table.

    A text has at least as many places as the widest filter.
    """
    words = _WORD.findall((text or "").lower())
    words += [""] * (max(WIDTHS) - len(words))
    place = {word: i for i, word in enumerate(dict.fromkeys(words))}
    return np.array([_parts(word) for word in place], np.int32), np.fromiter(map(place.__getitem__, words), np.int64, len(words))


def _pooled(model: Classifier, table: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of every filter over a text, and where it starts."""
    best = np.full((len(WIDTHS), FILTERS), -np.inf, np.float32)
    at = np.zeros((len(WIDTHS), FILTERS), np.int64)
    reach = max(WIDTHS) - 1
    # Every distinct word meets every filter column once; the text then only adds up what it finds.
    columns = np.concatenate([f[j] for f in model.filters for j in range(len(f))], axis=1)
    met = model.embedding[table].sum(axis=1) @ columns
    for start in range(0, max(1, len(words) - reach), _BLOCK):
        here = words[start:start + _BLOCK + reach]
        column = 0
        for w, width in enumerate(WIDTHS):
            n = len(here) - width + 1
            value = 0
            for j in range(width):
                value = value + np.ascontiguousarray(met[:, column:column + FILTERS])[here[j:j + n]]
                column += FILTERS
            where = value.argmax(axis=0)
            top = value[where, np.arange(FILTERS)] + model.biases[w]
            better = top > best[w]
            best[w][better], at[w][better] = top[better], where[better] + start
    return best, at


def score(model: Classifier, text: str | None) -> float:
    """Probability of label 1."""
    best, _ = _pooled(model, *word_buckets(text))
    z = float(np.maximum(best, 0).ravel() @ model.out + model.bias)
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> Classifier:
    """Stochastic gradient descent (Adagrad) on the logistic loss, both labels weighing the same in total."""
    rng = np.random.default_rng(seed)
    model = Classifier(
        rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32),
        [rng.normal(0, 0.3, (w, DIMENSION, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)
    model.embedding[0] = 0
    docs = [word_buckets(t) for t in texts]
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        # One label only: its share is all there is to learn.
        model.out[:] = 0
        model.bias = 0.0 if not len(y) else (6.0 if y[0] else -6.0)
        return model
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    squares = {"e": np.full(model.embedding.shape, 1e-6, np.float32), "o": np.full(model.out.shape, 1e-6, np.float32), "b": 1e-6}
    filter_squares = [np.full(f.shape, 1e-6, np.float32) for f in model.filters]
    bias_squares = [np.full(b.shape, 1e-6, np.float32) for b in model.biases]
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // _BATCH)):
            g_out, g_bias = np.zeros_like(model.out), 0.0
            g_filters, g_biases = [np.zeros_like(f) for f in model.filters], [np.zeros_like(b) for b in model.biases]
            rows, grads = [], []
            for i in batch:
                table, words = docs[i]
                best, at = _pooled(model, table, words)
                active = np.maximum(best, 0)
                z = float(active.ravel() @ model.out + model.bias)
                d = float(weight[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i])) / len(batch)
                g_out += d * active.ravel()
                g_bias += d
                back = d * model.out.reshape(best.shape) * (best > 0)
                for w, width in enumerate(WIDTHS):
                    g_biases[w] += back[w]
                    for j in range(width):
                        ids = table[words[at[w] + j]]
                        g_filters[w][j] += (model.embedding[ids].sum(axis=1) * back[w][:, None]).T
                        rows.extend(ids.T)
                        grads.extend([model.filters[w][j].T * back[w][:, None]] * ids.shape[1])
            ids, inverse = np.unique(np.concatenate(rows), return_inverse=True)
            g_e = np.zeros((len(ids), DIMENSION), np.float32)
            np.add.at(g_e, inverse, np.concatenate(grads))
            g_e += _DECAY * model.embedding[ids]
            g_e[ids == 0] = 0
            squares["e"][ids] += g_e ** 2
            model.embedding[ids] -= _RATE * g_e / np.sqrt(squares["e"][ids])
            for w in range(len(WIDTHS)):
                for value, grad, square in ((model.filters[w], g_filters[w], filter_squares[w]), (model.biases[w], g_biases[w], bias_squares[w])):
                    square += grad ** 2
                    value -= _RATE * grad / np.sqrt(square)
            squares["o"] += g_out ** 2
            model.out -= _RATE * g_out / np.sqrt(squares["o"])
            squares["b"] += g_bias ** 2
            model.bias -= _RATE * g_bias / np.sqrt(squares["b"])
    return model


def train(docs: DataFrame, labels: DataFrame, text_column: str = "text", label: str = "toxic", id_column: str = "doc_id") -> Classifier:
    """A classifier from ``docs`` and their ``labels`` of 0 or 1 (other labels are ignored).

    About SAMPLE_ROWS labels of each kind are chosen by hash before any text is read; this bounded table
    is broadcast to the documents.  Of a chosen text beyond SAMPLE_CHARS characters a slice of that many is read, at a
    place that its id and text decide, so no labelled row is left out for its length.
    """
    row = F.col("row")
    known = pack(labels).select(row[id_column].alias("name"), row[label].cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("name").isNotNull())
    wanted = F.broadcast(labelled_sample(known, "label", F.col("name").cast("string"), SAMPLE_ROWS, 2))
    place = F.pmod(F.xxhash64(F.lit(5), row[id_column], row[text_column]), F.greatest(F.length(row[text_column]) - SAMPLE_CHARS + 1, F.lit(1)))
    texts = pack(docs, name=row[id_column], text=row[text_column].substr((place + 1).cast("int"), F.lit(SAMPLE_CHARS))).drop("row").filter("text IS NOT NULL")
    chosen = texts.join(wanted, "name").select(F.col("name").cast("string").alias("name"), "text", "label").collect()
    chosen.sort(key=lambda r: (r["name"], r["text"], r["label"]))
    return fit([r["text"] for r in chosen], [r["label"] for r in chosen])


def apply(docs: DataFrame, model: Classifier, text_column: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([score(shared.value, t) for t in texts.to_pylist()], pa.float64())

    made = pack(docs).withColumn("score", scores.asNondeterministic()(F.col("row")[text_column]))
    return unpack(made, docs.columns, score=F.col("score"), predicted=(F.col("score") >= 0.5).cast("int"))


def thresholds(scored: DataFrame, language: str, label: str, steps: int = 200) -> DataFrame:
    """(lang, threshold): the score, on a grid, that gives each language's labelled rows the best F1.

    Counts per (language, step) are the only thing summed; ties go to the threshold nearest one half.
    A null language is a language.  Languages without a labelled row of each kind are left out.
    """
    step = F.least(F.floor(F.col("score") * steps), F.lit(steps - 1)).cast("int")
    counts = scored.select(F.col(language).alias("lang"), step.alias("step"), F.col(label).cast("int").alias("y")).groupBy("lang", "step").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    # At most ``steps`` rows per language here.
    per = counts.groupBy("lang").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.collect_list(
        F.struct("step", "pos", "neg")).alias("cells")).filter("all_pos > 0 AND all_neg > 0")
    grid = per.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))))
    above = F.aggregate("cells", F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n")), lambda s, c: F.struct(
        (s["p"] + F.when(c["step"] >= F.col("t"), c["pos"]).otherwise(0)).alias("p"),
        (s["n"] + F.when(c["step"] >= F.col("t"), c["neg"]).otherwise(0)).alias("n")))
    f1 = grid.withColumn("a", above).select("lang", (F.col("t") / F.lit(float(steps))).alias("threshold"), (
        2 * F.col("a.p") / (F.col("a.p") + F.col("a.n") + F.col("all_pos"))).alias("f1"))
    best = F.max(F.struct(F.round("f1", 9).alias("f1"), (-F.abs(F.col("threshold") - 0.5)).alias("near"), "threshold"))
    return f1.groupBy("lang").agg(best.alias("b")).select("lang", F.col("b.threshold").alias("threshold"))
