"""Nearest neighbours by inner product with hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node.  Nodes are dealt into shards of bounded size by hash; each shard's graph is
built in one task and stored as one row of flat arrays.  Queries stream past the graph of every shard, and
the best of all shards are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.llm.common import materialise

SHARD_ROWS = 8_192
LINKS = 16
EF_BUILD = 96
EF_SEARCH = 224


@dataclass
class Graph:
    """Vectors, and per layer its nodes (ascending) and their neighbours (one row each, -1 where none)."""
    vectors: np.ndarray
    nodes: list[np.ndarray]
    links: list[np.ndarray]
    entry: int


def _even(vectors: np.ndarray) -> np.ndarray:
    """Vectors in single precision with one more component that gives all one length: largest inner product is then nearest.

    They are scaled to length one at most first, so that no component is lost.
    """
    # The largest component goes first, because its square may be too large.
    vectors = vectors.astype(np.float64) / max(np.abs(vectors).max(initial=0), np.finfo(float).tiny)
    squares = (vectors ** 2).sum(axis=1)
    extra = np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))
    return (np.hstack([vectors, extra[:, None]]) / max(np.sqrt(squares.max(initial=0)), np.finfo(float).tiny)).astype(np.float32)


class _Walk:
    """Best-first search in the layers of a graph, with marks that need no clearing."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], place: list[np.ndarray]):
        self.vectors, self.links, self.place = vectors, links, place
        self.marks, self.turn = np.zeros(len(vectors), np.int64), 0

    def layer(self, query: np.ndarray, starts: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef best (score, node) that the walk meets, best first."""
        self.turn += 1
        marks, turn, vectors, links, place = self.marks, self.turn, self.vectors, self.links[level], self.place[level]
        for _, node in starts:
            marks[node] = turn
        open_ = [(-s, node) for s, node in starts]
        heapq.heapify(open_)
        best = list(starts)
        heapq.heapify(best)
        while open_:
            score, node = heapq.heappop(open_)
            if len(best) >= ef and -score < best[0][0]:
                break
            near = links[place[node]]
            near = near[near >= 0]
            near = near[marks[near] != turn]
            if not len(near):
                continue
            marks[near] = turn
            scores = vectors[near] @ query
            if len(best) >= ef:
                good = scores > best[0][0]
                near, scores = near[good], scores[good]
            for s, other in zip(scores.tolist(), near.tolist()):
                if len(best) < ef:
                    heapq.heappush(best, (s, other))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, other))
                else:
                    continue
                heapq.heappush(open_, (-s, other))
        return sorted(best, reverse=True)


def _diverse(vectors: np.ndarray, found: list[tuple[float, int]], most: int) -> list[int]:
    """Neighbours nearer to the new node than to one another; the nearest others fill what is left."""
    ids = np.array([node for _, node in found])
    between = vectors[ids] @ vectors[ids].T
    kept: list[int] = []
    closest = np.full(len(ids), -np.inf)
    for i, (score, _) in enumerate(found):
        if closest[i] < score:
            kept.append(i)
            if len(kept) == most:
                break
            np.maximum(closest, between[i], out=closest)
    taken = set(kept)
    left = [i for i in range(len(found)) if i not in taken]
    return ids[kept + left[:most - len(kept)]].tolist()


def build(raw: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 1) -> Graph:
    """The graph of the rows of ``raw``, inserted in order."""
    vectors, n = _even(raw), len(raw)
    rng = np.random.default_rng(seed)
    levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(int), 12)
    nodes = [np.flatnonzero(levels >= level) for level in range(levels.max(initial=0) + 1)]
    tables = [np.full((len(own), links * (1 if level else 2)), -1, np.int32) for level, own in enumerate(nodes)]
    place = []
    for own in nodes:
        at = np.full(n, -1, np.int64)
        at[own] = np.arange(len(own))
        place.append(at)
    walk, entry, top = _Walk(vectors, tables, place), 0, int(levels[0]) if n else 0
    for node in range(1, n):
        query, level = vectors[node], int(levels[node])
        starts = [(float(vectors[entry] @ query), entry)]
        for upper in range(top, level, -1):
            starts = walk.layer(query, starts, 1, upper)
        for here in range(min(top, level), -1, -1):
            starts = walk.layer(query, starts, ef, here)
            table, at = tables[here], place[here]
            chosen = _diverse(vectors, starts[:ef // 2], links)
            table[at[node], :len(chosen)] = chosen
            for other in chosen:
                row = table[at[other]]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = node
                    continue
                # A full row is chosen anew from its neighbours and the new node, by the same rule.
                near = np.append(row, node)
                scores = vectors[near] @ vectors[other]
                ranked = np.argsort(-scores, kind="stable").tolist()
                row[:] = _diverse(vectors, [(float(scores[i]), int(near[i])) for i in ranked], len(row))
        if level > top:
            entry, top = node, level
    return Graph(raw, nodes, tables, entry)


def search(graph: Graph, queries: np.ndarray, k: int, ef: int = EF_SEARCH) -> list[np.ndarray]:
    """Up to k nodes per query, largest inner product first."""
    vectors, n = _even(graph.vectors), len(graph.vectors)
    place = []
    for own in graph.nodes:
        at = np.full(n, -1, np.int64)
        at[own] = np.arange(len(own))
        place.append(at)
    walk, found = _Walk(vectors, graph.links, place), []
    length = np.abs(queries).max(axis=1, initial=0, keepdims=True)
    for query in np.hstack([queries / np.maximum(length, np.finfo(float).tiny), np.zeros((len(queries), 1))]).astype(np.float32):
        starts = [(float(vectors[graph.entry] @ query), graph.entry)]
        for upper in range(len(graph.nodes) - 1, 0, -1):
            starts = walk.layer(query, starts, 1, upper)
        found.append(np.array([node for _, node in walk.layer(query, starts, max(ef, k), 0)[:k]], np.int64))
    return found


_INDEX = "dim int, shard int, ids array<long>, vectors array<double>, entry int, layers array<int>, nodes array<int>, links array<int>"


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("node")
    raw = np.stack(rows["v"].to_numpy()).astype(np.float64)
    graph = build(raw)
    return pd.DataFrame({
        "dim": [raw.shape[1]], "shard": [rows["shard"].iloc[0]], "ids": [rows["node"].to_numpy()], "vectors": [raw.ravel()],
        "entry": [graph.entry], "layers": [np.array([len(own) for own in graph.nodes])],
        "nodes": [np.concatenate(graph.nodes)], "links": [np.concatenate([t.ravel() for t in graph.links])]})


def _load(row) -> tuple[Graph, np.ndarray]:
    vectors = np.asarray(row["vectors"], np.float64).reshape(-1, int(row["dim"]))
    nodes, links, at, low = [], [], 0, 0
    for level, size in enumerate(map(int, row["layers"])):
        width = LINKS * (1 if level else 2)
        nodes.append(np.asarray(row["nodes"][at:at + size], np.int64))
        links.append(np.asarray(row["links"][low:low + size * width], np.int32).reshape(size, width))
        at, low = at + size, low + size * width
    return Graph(vectors, nodes, links, int(row["entry"])), np.asarray(row["ids"], np.int64)


def usable(vector: Column) -> Column:
    """True unless a vector is null, empty, zero, or holds a null or a component that is not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, copies): (node, v) of each distinct vector, and (node, id) of the ``keep`` smallest ids that have it.

    No answer can need more ids of one vector.  A row stated twice is one row; different vectors under one id are
    rows of their own.  Copies are thinned in three rounds of ever fewer groups, so a vector that very many rows
    share is spread.  Both tables are written.
    """
    thinned = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for salts in (64, 8, 1):
        window = Window.partitionBy("v", "salt").orderBy("id")
        thinned = thinned.withColumn("salt", F.pmod("salt", F.lit(salts))).withColumn("r", F.row_number().over(window)).filter(
            F.col("r") <= keep).drop("r")
    thinned = materialise(thinned.drop("salt"))
    nodes = materialise(thinned.select("v").distinct().withColumn("node", F.monotonically_increasing_id()))
    return nodes, materialise(thinned.join(nodes, "v").select("node", "id"))


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per (dimension, shard) with its graph, from (node, v); written once."""
    sized = vectors.withColumn("dim", F.size("v"))
    counts = sized.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select(
        "dim", F.ceil(F.col("n") / shard_rows).alias("shards"))
    dealt = sized.join(counts, "dim").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    # Vectors are small and graphs are slow to build: a fixed number of partitions, which AQE does not merge.
    total = counts.agg(F.sum("shards")).first()[0] or 1
    spread = dealt.select("dim", "shard", "node", "v").repartition(4 * total, "dim", "shard")
    return materialise(spread.groupBy("dim", "shard").applyInPandas(_build_shard, _INDEX))


def _search_stream(k: int, ef: int):
    """Rows come by shard, its graph first and then all queries: each graph is held once while they stream past."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = ids = None
        for batch in batches:
            if batch.empty:
                continue
            starts = np.flatnonzero(batch["graph"].notna().to_numpy())
            for a, b in zip([0, *starts], [*starts, len(batch)]):
                part = batch.iloc[a:b]
                if not len(part):
                    continue
                if part["graph"].iloc[0] is not None:
                    graph, ids = _load(part["graph"].iloc[0])
                    part = part.iloc[1:]
                if not len(part):
                    continue
                asked = np.stack(part["v"].to_numpy()).astype(np.float64)
                found = search(graph, asked, k, ef)
                out = pd.DataFrame({"query": np.repeat(part["query"].to_numpy("int64"), [len(f) for f in found]),
                                    "node": np.concatenate([ids[f] for f in found])})
                with np.errstate(over="ignore", invalid="ignore"):
                    out["score"] = np.concatenate([(graph.vectors[f] * v).sum(axis=1) for f, v in zip(found, asked)])
                yield out

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id",
            vector_column: str = "embedding", shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """(query_id, rank, <id>, score): up to k rows of ``vectors`` nearest to each row of ``queries``, itself excluded.

    Both tables have the id and the vector column; a query finds vectors of its own dimension.  The score
    is the inner product of the vectors as given, in double precision; ties go to the smaller id.  Unusable vectors
    (see ``usable``) and null ids take no part.  A row stated twice counts once, as a query and as a candidate;
    different vectors under one id are rows of their own, so such an id may be asked, and found, with each of them.
    Empty tables give no rows.
    """
    def clean(df):
        row = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"))
        return row.filter(F.col("id").isNotNull() & usable(F.col("v")))

    nodes, copies = distinct_vectors(clean(vectors), k + 1)
    graphs = index(nodes, shard_rows)
    shards = graphs.groupBy("dim").agg(F.max("shard").alias("last"))
    asked = materialise(clean(queries).distinct().withColumn("query", F.monotonically_increasing_id()))
    sent = asked.withColumn("dim", F.size("v")).join(shards, "dim").select(
        "dim", F.explode(F.sequence(F.lit(0), "last")).alias("shard"), "query", "v")
    kept = F.struct(*graphs.columns).alias("graph")
    rows = graphs.select("dim", "shard", F.lit(0).alias("kind"), kept, F.lit(None).cast("long").alias("query"), F.lit(None).cast("array<double>").alias("v"))
    rows = rows.unionByName(sent.select("dim", "shard", F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["graph"].dataType).alias("graph"), "query", "v"))
    dealt = rows.repartition(4 * graphs.count() or 1, "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    hits = dealt.select("graph", "query", "v").mapInPandas(_search_stream(k + 1, ef), "query long, node long, score double")
    # The best k + 1 vectors of a query over all shards, then their ids.
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    merged = hits.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    own = asked.join(nodes, "v", "left").select("query", F.col("id").alias("query_id"), F.col("node").alias("own"))
    named = merged.join(copies, "node").join(own, "query").filter(~((F.col("id") == F.col("query_id")) & F.col("node").eqNullSafe(F.col("own"))))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "node")
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_column), "score")
