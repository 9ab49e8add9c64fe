"""Layered pairwise ranker: rectified hidden layers, a linear score, and an early-stopped distributed fit.

The training pairs are written once, in blocks bucketed by their number.  Every step computes one gradient per
block inside the task that holds it, adds the gradients up in fixed point (so neither partitioning nor order
shows) and brings back as many numbers as the model has weights.  Validation after every epoch is one pass over
lists bucketed by query, without an exchange of their rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.operators.pairs import CAND, QUERY
from rankweave.session import materialise_by

PATIENCE = 20
LEAST_GAIN = 1e-5
BLOCK_PAIRS = 65_536
WARM_EPOCHS = 5
_DECAY, _CLIP = 1e-3, 1.0
_FIXED = 2.0 ** 40  # gradients are summed in parts of this


@dataclass(frozen=True)
class LayeredModel:
    """Weights (inputs x units) and offsets of each layer; the last has one unit and no rectifier."""
    weights: tuple[np.ndarray, ...]
    offsets: tuple[np.ndarray, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        for w, b in zip(self.weights[:-1], self.offsets[:-1]):
            x = np.maximum(x @ w + b, 0.0)
        return (x @ self.weights[-1] + self.offsets[-1])[:, 0]

    def flat(self) -> np.ndarray:
        return np.concatenate([part.ravel() for pair in zip(self.weights, self.offsets) for part in pair])

    def like(self, values: np.ndarray) -> LayeredModel:
        """The same shape with other numbers."""
        weights, offsets, at = [], [], 0
        for w, b in zip(self.weights, self.offsets):
            weights.append(values[at:at + w.size].reshape(w.shape))
            offsets.append(values[at + w.size:at + w.size + b.size])
            at += w.size + b.size
        return LayeredModel(tuple(weights), tuple(offsets))

    def gradient(self, positive: np.ndarray, negative: np.ndarray, margin: float) -> tuple[float, np.ndarray]:
        """Sum over pairs of log(1 + exp(score(neg) - score(pos) + margin)) and its gradient."""
        x = [np.concatenate([positive, negative])]
        for w, b in zip(self.weights[:-1], self.offsets[:-1]):
            x.append(np.maximum(x[-1] @ w + b, 0.0))
        score = (x[-1] @ self.weights[-1] + self.offsets[-1])[:, 0]
        pairs = len(positive)
        gap = score[pairs:] - score[:pairs] + margin
        loss = float((np.maximum(gap, 0.0) + np.log1p(np.exp(-np.abs(gap)))).sum())
        share = np.where(gap >= 0, 1.0 / (1.0 + np.exp(-np.abs(gap))), np.exp(-np.abs(gap)) / (1.0 + np.exp(-np.abs(gap))))
        back, parts = np.concatenate([-share, share])[:, None], []
        for layer in range(len(self.weights) - 1, -1, -1):
            parts.append((x[layer].T @ back, back.sum(axis=0)))
            if layer:
                back = (back @ self.weights[layer].T) * (x[layer] > 0)
        return loss, np.concatenate([part.ravel() for pair in reversed(parts) for part in pair])

    def to_json(self) -> str:
        return json.dumps({"weights": [w.tolist() for w in self.weights], "offsets": [b.tolist() for b in self.offsets]})

    @staticmethod
    def from_json(text: str) -> LayeredModel:
        parts = json.loads(text)
        return layered(parts["weights"], parts["offsets"])


def layered(weights: Sequence, offsets: Sequence) -> LayeredModel:
    """A model of given numbers; shapes that do not fit are an error."""
    w = tuple(np.array(part, float) for part in weights)
    b = tuple(np.array(part, float) for part in offsets)
    fits = len(w) == len(b) and w and w[-1].shape[1] == 1 and all(x.shape[1] == len(y) for x, y in zip(w, b))
    if not fits or any(x.shape[1] != y.shape[0] for x, y in zip(w, w[1:])):
        raise ValueError("the layers do not fit together")
    return LayeredModel(w, b)


def fresh_model(inputs: int, hidden: Sequence[int], seed: int) -> LayeredModel:
    """Uniform start weights: bounded by sqrt(6 / inputs) for hidden layers, sqrt(6 / (inputs + 1)) for the score."""
    rng, sizes = np.random.default_rng(seed), [inputs, *hidden, 1]
    bounds = [math.sqrt(6 / a) for a in sizes[:-2]] + [math.sqrt(6 / (sizes[-2] + 1))]
    weights = [rng.uniform(-bound, bound, (a, b)) for bound, a, b in zip(bounds, sizes, sizes[1:])]
    return LayeredModel(tuple(weights), tuple(np.zeros(b) for b in sizes[1:]))


def layered_score(df: DataFrame, features: Sequence[str], model: LayeredModel, name: str = "score") -> DataFrame:
    """Add the model's score of every row, in Arrow batches; a row with a null feature has a null score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def apply(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.column_stack([c.to_numpy("float64", na_value=np.nan) for c in columns])
            scores = pd.Series(shared.value.score(x))
            yield scores.where(~np.isnan(x).any(axis=1), None)

    return df.withColumn(name, apply(*[F.col(c) for c in features]))


@dataclass(frozen=True)
class TrainingPairs:
    """Standardised pairs in blocks: the written table, its number of pairs and blocks, and the features' moments."""
    table: DataFrame
    features: tuple[str, ...]
    pairs: int
    blocks: int
    mean: np.ndarray
    deviation: np.ndarray


def prepare_pairs(pairs: DataFrame, features: Sequence[str], block_pairs: int = BLOCK_PAIRS) -> TrainingPairs:
    """Pairs with a positive and a negative side (``pos_<f>``, ``neg_<f>``), standardised over both sides and written in blocks.

    A pair's block is a hash of its keys, so blocks do not depend on how the input is partitioned.
    """
    features = tuple(features)
    sides = [F.array(F.col(f"pos_{f}"), F.col(f"neg_{f}")) for f in features]
    values = pairs.select(F.explode(F.arrays_zip(*[s.alias(f) for s, f in zip(sides, features)])).alias("v")).select("v.*")
    row = values.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features], F.count(F.lit(1)).alias("n")).first()
    mean = np.array([row[f"m_{f}"] or 0.0 for f in features])
    deviation = np.array([max(row[f"s_{f}"] or 0.0, 1e-6) for f in features])
    count = row["n"] // 2
    blocks = max(1, -(-count // block_pairs))
    key = F.xxhash64(QUERY, "pos_key", "neg_key")
    side = lambda s: [((F.col(f"{s}_{f}") - float(m)) / float(d)).alias(f"{s}_{f}") for f, m, d in zip(features, mean, deviation)]
    table = pairs.select(F.pmod(key, F.lit(blocks)).cast("int").alias("block"), key.alias("place"), *side("pos"), *side("neg"))
    return TrainingPairs(materialise_by(table, "block"), features, count, blocks, mean, deviation)


def gradient(data: TrainingPairs, model: LayeredModel, margin: float = 0.0, step: int = 0, steps: int = 1) -> tuple[float, np.ndarray]:
    """Mean loss and its gradient over the blocks of one step of an epoch (block modulo ``steps``)."""
    pos, neg = [f"pos_{f}" for f in data.features], [f"neg_{f}" for f in data.features]
    size = len(model.flat())

    def block_gradient(rows: pa.Table) -> pa.Table:
        # One order of the pairs, whatever order they arrive in.
        rows = rows.sort_by([("place", "ascending"), *[(c, "ascending") for c in (*pos, *neg)]])
        side = lambda names: np.column_stack([rows[c].to_numpy() for c in names])
        loss, slope = model.gradient(side(pos), side(neg), margin)
        fixed = np.rint(np.concatenate([[loss], slope]) * _FIXED)
        return pa.table([pa.array(range(-1, size), pa.int32()), pa.array([int(v) for v in fixed], pa.decimal128(38, 0)),
                         pa.array([rows.num_rows] * (size + 1), pa.int64())], ["place", "value", "n"])

    chosen = data.table if steps == 1 else data.table.filter(F.pmod("block", F.lit(steps)) == step)
    parts = chosen.groupBy("block").applyInArrow(block_gradient, "place int, value decimal(38,0), n long")
    found = {r["place"]: r for r in parts.groupBy("place").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).collect()}
    if not found:
        return 0.0, np.zeros(size)
    scale = _FIXED * found[-1]["n"]
    return int(found[-1]["value"]) / scale, np.array([int(found[i]["value"]) / scale for i in range(size)])


def prepare_lists(lists: DataFrame, features: Sequence[str], data: TrainingPairs) -> DataFrame:
    """Validation lists (query_id, cand_key, rank, is_truth, features) standardised like the pairs, bucketed by query."""
    scaled = [((F.col(f) - float(m)) / float(d)).alias(f) for f, m, d in zip(features, data.mean, data.deviation)]
    return materialise_by(lists.select(QUERY, CAND, "rank", F.coalesce("is_truth", F.lit(False)).alias("is_truth"), *scaled), QUERY)


def list_mrr(scored: DataFrame) -> float:
    """Mean reciprocal rank of the best placed answer, ties in list order; lists without an answer count 0."""
    whole = Window.partitionBy(QUERY)
    best = F.max(F.when(F.col("is_truth"), F.struct("score", (-F.col("rank")).alias("r")))).over(whole)
    ahead = (F.struct("score", (-F.col("rank")).alias("r")) > F.col("_best")).cast("int")
    per = scored.withColumn("_best", best).groupBy(QUERY).agg(
        F.when(F.max("_best").isNull(), 0.0).otherwise(F.lit(1.0) / (F.sum(ahead) + 1)).alias("rr"))
    # Fixed point here as well: the mean does not depend on the order of queries.
    row = per.agg(F.sum(F.round(F.col("rr") * F.lit(2.0 ** 40)).cast("decimal(30,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return int(row["s"]) / 2.0 ** 40 / row["n"] if row["n"] else 0.0


@dataclass(frozen=True)
class Fit:
    model: LayeredModel
    best_epoch: int
    best_mrr: float
    history: tuple[tuple[int, float, float, bool], ...]  # epoch, loss, validation MRR, chosen
    stopped_early: bool


def fit_layered(
    data: TrainingPairs, validation: DataFrame, hidden: Sequence[int] = (64, 32), seed: int = 42, learning_rate: float = 1e-2,
    margin: float = 0.0, max_epochs: int = 100, patience: int = PATIENCE, least_gain: float = LEAST_GAIN, steps: int = 1,
) -> Fit:
    """Fit by AdamW, keeping the earliest epoch with the best validation MRR.

    An epoch counts as better only above the best by more than ``least_gain``; after ``patience`` epochs without one
    the fit ends.  The rate falls along a cosine to a hundredth after the first five epochs; steps are clipped to
    norm 1.  ``validation`` comes from ``prepare_lists``.
    """
    model = fresh_model(len(data.features), hidden, seed)
    values = model.flat()
    first, second, t = np.zeros_like(values), np.zeros_like(values), 0
    history: list[tuple[int, float, float, bool]] = []
    best, best_epoch, best_mrr, idle = values.copy(), 0, -math.inf, 0
    for epoch in range(1, max_epochs + 1):
        falls = max(0, epoch - 1 - WARM_EPOCHS)
        rate = learning_rate * (0.01 + 0.99 * (1 + math.cos(math.pi * min(1.0, falls / max(max_epochs - WARM_EPOCHS, 1)))) / 2)
        losses = []
        for step in range(steps):
            loss, slope = gradient(data, model.like(values), margin, step, steps)
            losses.append(loss)
            norm = float(np.sqrt((slope ** 2).sum()))
            slope, t = slope * min(1.0, _CLIP / (norm + 1e-6)), t + 1
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope ** 2
            values = values * (1 - rate * _DECAY) - rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
        mrr = list_mrr(layered_score(validation, data.features, model.like(values)))
        better = best_epoch == 0 or mrr > best_mrr + least_gain
        history.append((epoch, float(np.mean(losses)), mrr, better))
        if better:
            best, best_epoch, best_mrr, idle = values.copy(), epoch, mrr, 0
        else:
            idle += 1
        if idle >= patience:
            break
    return Fit(model.like(best), best_epoch, best_mrr, tuple(history), len(history) < max_epochs)
