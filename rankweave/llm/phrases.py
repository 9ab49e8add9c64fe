"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are runs of three words, edges runs of four, weighted by how often they occur.  Only the longest
runs are counted in the texts: every word begins one, and where a piece ends first the run is filled with
an end mark (the piece-end correction).  Counts of shorter runs are flows: what leaves a node, end marks
included, is how often the node occurs, and likewise for pairs and words.  Unary paths of the graph are
compacted before phrases are scored, so a long repeated passage is one row.

A word that occurs less than ``least`` times in its language cannot be part of a phrase; pieces end before
it, and no other count changes by that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.blocks import Numbering, squeeze, stretch
from rankweave.llm.common import materialise, pack
from rankweave.scale import ranked
from rankweave.session import materialise_by

LEAST = 30
TOP = 2_000
COVERED = (100, 80)  # a phrase goes if 100 times a longer one reach 80 times its own count
BLOCK_WORDS = 4_000_000
SHARE_WORDS = 2_000_000  # words that one share of the graph stands for
UNKNOWN = "und"

# Bytes that end a piece.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_SOURCE = bytes(range(65, 91)) + b"\t" + _ENDS
_TARGET = bytes(range(97, 123)) + b" " + b"\n" * len(_ENDS)
_TABLE = bytes.maketrans(_SOURCE, _TARGET)
_END = b"\n"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def words_of(text: str) -> list[bytes]:
    """Words of a text (A-Z lowered) with an end mark after every piece."""
    return list(filter(None, text.encode().translate(_TABLE).replace(_END, b" \n ").split(b" "))) + [_END]


def _number(block_words: int):
    """One row a block: its language, its word numbers, its distinct words and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ordinal, held, states = TaskContext.get().partitionId(), 0, 0, {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ordinal
            for lang, state in states.items():
                words, texts, counts = state.by_count()
                real = [i for i, w in enumerate(words) if w != _END]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) | ordinal], pa.int64()), pa.array([lang], pa.string()),
                     pa.array([squeeze(np.concatenate(texts))], pa.binary()), pa.array([real], pa.list_(pa.int32())),
                     pa.array([[words[i].decode() for i in real]], pa.list_(pa.string())),
                     pa.array([counts[real]], pa.list_(pa.int64()))], ["block", "lang", "body", "place", "word", "n"])
                ordinal += 1

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found = words_of(text)
                if lang not in states:
                    states[lang] = Numbering()
                states[lang].add(found)
                held += len(found)
                if held >= block_words:
                    yield from flush()
                    held, states = 0, {}
        if states:
            yield from flush()

    return run


def _grouped(columns: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of numbers below ``width``, and where in it each distinct row begins."""
    rank, top = columns[0].astype(np.int64), width
    for column in columns[1:]:
        if top > (1 << 62) // width:
            _, rank = np.unique(rank, return_inverse=True)
            top = int(rank.max(initial=0)) + 1
        rank, top = rank * width + column, top * width
    order = np.argsort(rank, kind="stable")
    rank = rank[order]
    return order, np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])[:len(rank)])


def _sums(columns: list[np.ndarray], weights: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    order, first = _grouped(columns, width)
    if not len(order):
        return columns, weights
    return [c[order[first]] for c in columns], np.add.reduceat(weights[order], first)


def _shared_out(columns: list[np.ndarray], weights: np.ndarray, keys: int, shares: int) -> tuple[list[int], list[bytes]]:
    """Rows dealt by a hash of their first ``keys`` columns, packed: one body a share that has any."""
    mixed = np.zeros(len(weights), np.uint64)
    for column, factor in zip(columns[:keys], _MIX):
        mixed = (mixed ^ column.astype(np.uint64)) * factor
        mixed ^= mixed >> np.uint64(29)
    share = (mixed % np.uint64(shares)).astype(np.int64)
    order = np.argsort(share, kind="stable")
    ends = np.searchsorted(share[order], np.arange(shares + 1))
    full = np.flatnonzero(np.diff(ends)).tolist()
    rows = np.stack([*columns, weights])[:, order]
    return full, [squeeze(rows[:, ends[s]:ends[s + 1]].ravel(), "<u8") for s in full]


def _unpack(bodies: list[bytes], width: int) -> np.ndarray:
    return np.concatenate([stretch(b, "<u8").view(np.int64).reshape(width, -1) for b in bodies], axis=1)


def _edges(shares: int):
    """Longest runs of a block, counted and dealt by node."""
    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        numbers = known["number"].to_numpy()
        order = np.argsort(numbers, kind="stable")
        full, bodies = [], []
        if block.num_rows and len(numbers):
            sequence = stretch(block["body"][0].as_py())
            local = np.zeros(int(sequence.max()) + 1, np.int64)
            local[known["place"].to_numpy()[order]] = np.arange(1, len(numbers) + 1)
            s = np.concatenate([local[sequence], np.zeros(3, np.int64)])
            a, b, c, d = s[:-3], s[1:-2], s[2:-1], s[3:]
            c = np.where(b > 0, c, 0)
            d = np.where(c > 0, d, 0)
            at = a > 0
            columns, weights = _sums([x[at] for x in (a, b, c, d)], np.ones(int(at.sum()), np.int64), len(numbers) + 1)
            real = np.concatenate([[0], numbers[order]])
            full, bodies = _shared_out([real[x] for x in columns], weights, 3, shares)
        return pa.table([pa.array(full, pa.int32()), pa.array(bodies, pa.binary())], ["share", "body"])

    return run


_COUNTED = "level int, share int, body binary, a long, b long, c long, d long, n long"


def _table(level: int, columns: list[np.ndarray], n: np.ndarray) -> pa.Table:
    size = len(n)
    filled = [pa.array(x, pa.int64()) for x in columns] + [pa.nulls(size, pa.int64())] * (4 - len(columns))
    return pa.table([pa.array(np.full(size, level, np.int32)), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary()), *filled,
                     pa.array(n, pa.int64())], ["level", "share", "body", "a", "b", "c", "d", "n"])


def _flows(least: int, shares: int):
    """One share of the graph: edges and nodes that occur often, and what the nodes add to pairs."""
    def run(packed: pa.Table) -> pa.Table:
        rows = _unpack(packed["body"].to_pylist(), 5)
        ids, dense = np.unique(rows[:4], return_inverse=True)
        if ids[0] != 0:
            ids, dense = np.concatenate([[0], ids]), dense + 1
        (a, b, c, d), weight = _sums(list(dense.reshape(4, -1)), rows[4], len(ids))
        often = (d > 0) & (weight >= least)
        edges = _table(4, [ids[x[often]] for x in (a, b, c, d)], weight[often])
        (a, b, c), flow = _sums([a, b, c], weight, len(ids))
        often = (c > 0) & (flow >= least)
        nodes = _table(3, [ids[x[often]] for x in (a, b, c)], flow[often])
        (a, b), flow = _sums([a, b], flow, len(ids))
        full, bodies = _shared_out([ids[a], ids[b]], flow, 2, shares)
        size = len(full)
        pairs = pa.table([pa.array(np.full(size, 2, np.int32)), pa.array(full, pa.int32()), pa.array(bodies, pa.binary()),
                          *[pa.nulls(size, pa.int64())] * 5], edges.column_names)
        return pa.concat_tables([edges, nodes, pairs])

    return run


def _pair_flows(least: int):
    """Pairs that occur often, and what all pairs of this share add to their first words."""
    def run(packed: pa.Table) -> pa.Table:
        rows = _unpack(packed["body"].to_pylist(), 3)
        ids, dense = np.unique(rows[:2], return_inverse=True)
        (a, b), flow = _sums(list(dense.reshape(2, -1)), rows[2], len(ids))
        often = (ids[b] > 0) & (flow >= least)
        pairs = _table(2, [ids[a[often]], ids[b[often]]], flow[often])
        (a,), flow = _sums([a], flow, len(ids))
        return pa.concat_tables([pairs, _table(1, [ids[a]], flow)])

    return run


def graph(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", least: int = LEAST,
          block_words: int = BLOCK_WORDS) -> dict[str, DataFrame]:
    """The parts of the graph that occur at least ``least`` times, all counts exact, and totals.

    ``totals`` (lang, total: all word occurrences), ``words`` (a, lang, word, n), ``pairs`` (a, b, n), ``nodes``
    (a, b, c, n) and ``edges`` (a, b, c, d, n) of word numbers.  A null language is ``und``, a null text empty.
    """
    texts = pack(docs, lang=F.coalesce(F.col("row")[lang_column].cast("string"), F.lit(UNKNOWN)),
                 text=F.coalesce(F.col("row")[text_column], F.lit(""))).drop("row")
    blocks = materialise_by(texts.mapInArrow(
        _number(block_words), "block long, lang string, body binary, place array<int>, word array<string>, n array<long>"), "block")
    listed = blocks.select("block", "lang", F.explode(F.arrays_zip("place", "word", "n")).alias("w")).select("block", "lang", "w.*")
    totals = blocks.select("lang", F.aggregate("n", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(
        F.sum("n").alias("total")).filter("total > 0")
    # Numbered by frequency: frequent words have small numbers, which pack well.
    often = materialise(listed.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    often = materialise(ranked(often, [], [-F.col("n"), F.col("lang"), F.col("word")], "number").select("number", "lang", "word"))
    known = listed.select("block", "lang", "place", "word").join(often, ["lang", "word"]).select(
        F.col("block").alias("of"), "place", "number")
    size = totals.agg(F.sum("total")).first()[0] or 0
    shares = int(size // SHARE_WORDS) + 1
    packed = blocks.select("block", "body").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(
        _edges(shares), "share int, body binary")
    counted = materialise(packed.groupBy("share").applyInArrow(_flows(least, shares), _COUNTED))
    shorter = materialise(counted.filter("level = 2").select("share", "body").groupBy("share").applyInArrow(_pair_flows(least), _COUNTED))
    words = shorter.filter("level = 1").groupBy("a").agg(F.sum("n").alias("n")).join(
        often.withColumnRenamed("number", "a"), "a").select("a", "lang", "word", "n")
    return {"totals": totals, "words": words, "pairs": shorter.filter("level = 2").select("a", "b", "n"),
            "nodes": counted.filter("level = 3").select("a", "b", "c", "n"),
            "edges": counted.filter("level = 4").select("a", "b", "c", "d", "n")}


def compact(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Unary paths: (words array, weights array, flows array), every edge in exactly one of them.

    Two edges that meet in a node with no other edge are one path.  Places in a path come from pointer
    doubling, so rounds grow with the logarithm of the longest path.  Edges of a closed path without a branch
    stay apart.  ``flows`` has the count of every node of the path in order, one more than ``weights``.
    """
    flow = nodes.select("a", "b", "c", F.col("n").alias("flow"))
    listed = materialise(edges.join(flow, ["a", "b", "c"]).withColumn("e", F.monotonically_increasing_id()))
    into = listed.groupBy(*[F.col(x).alias(y) for x, y in zip("bcd", "abc")]).agg(F.count("e").alias("i"), F.min("e").alias("up"))
    out = listed.groupBy("a", "b", "c").agg(F.count("e").alias("o"), F.min("e").alias("e"))
    link = out.join(into, ["a", "b", "c"]).filter("i = 1 AND o = 1 AND e <> up").select("e", "up")
    # (edge, an edge before it, how far before, whether that one begins a path)
    state = materialise(listed.select("e").join(link, "e", "left").select(
        "e", F.coalesce("up", "e").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("far"), F.col("up").isNull().alias("done")))
    count, left = state.agg(F.count("e"), F.count(F.when(~F.col("done"), 1))).first()
    for _ in range(int(count).bit_length() + 1):
        if not left:
            break
        above = state.select(F.col("e").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("done").alias("done2"))
        state = materialise(state.join(above, "up").select("e", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"), F.col("done2").alias("done")))
        left = state.filter("NOT done").count()
    head = state.select("e", F.when(F.col("done"), F.col("up")).otherwise(F.col("e")).alias("head"), F.when(F.col("done"), F.col("far")).otherwise(0).alias("far"))
    paths = listed.join(head, "e").groupBy("head").agg(F.sort_array(F.collect_list(F.struct("far", "a", "b", "c", "d", "n", "flow"))).alias("p"))
    last = F.element_at("p", -1)
    whole = paths.withColumns({"a": last["b"], "b": last["c"], "c": last["d"]}).join(flow.withColumnRenamed("flow", "end"), ["a", "b", "c"])
    return whole.select(F.concat(F.array(F.col("p")[0]["a"], F.col("p")[0]["b"], F.col("p")[0]["c"]), F.col("p.d")).alias("words"),
                        F.col("p.n").alias("weights"), F.concat(F.col("p.flow"), F.array("end")).alias("flows"))


def _score(n: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(2_000_000).cast("decimal(8,0)") * wide(n), wide(left) + wide(right)).cast("long")


def _lowest(n: Column, cuts: list[tuple[Column, Column]]) -> Column:
    """The cut with the lowest score, the first of equals."""
    return F.array_min(F.array(*[F.struct(_score(n, l, r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))
                                 for k, (l, r) in enumerate(cuts, 1)]))


def candidates(parts: dict[str, DataFrame]) -> DataFrame:
    """Every phrase of two to four words that is not covered by a longer one: lang, phrase, n, and ``cut`` (score, k, l, r)."""
    often, most = COVERED
    word = parts["words"]
    ends = lambda x: word.select(F.col("a").alias(x), F.col("word").alias(f"w{x}"), F.col("n").alias(f"n{x}"), *(["lang"] if x == "a" else []))
    pairs = materialise(parts["pairs"].join(ends("a"), "a").join(ends("b"), "b"))
    paths = materialise(compact(parts["edges"], parts["nodes"]))
    nodes = parts["nodes"]

    def pair(x: str, y: str) -> DataFrame:
        """Pairs under the names of two places of a longer phrase."""
        return pairs.select(F.col("a").alias(x), F.col("b").alias(y), F.col("n").alias(f"n{x}{y}"), F.col("wa").alias(f"w{x}"), F.col("wb").alias(f"w{y}"),
                            F.col("na").alias(f"n{x}"), F.col("nb").alias(f"n{y}"), F.col("lang").alias(f"lang{x}"))

    # Where a longer phrase is most often: nodes below edges, pairs below nodes.
    steps = paths.select(F.explode(F.transform("flows", lambda _, i: F.struct(
        F.get("words", i).alias("a"), F.get("words", i + 1).alias("b"), F.get("words", i + 2).alias("c"),
        F.greatest(F.get("weights", i - 1), F.get("weights", i)).alias("most")))).alias("s")).select("s.*")
    above_nodes = steps.groupBy("a", "b", "c").agg(F.max("most").alias("most"))
    above_pairs = nodes.select(F.explode(F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("c").alias("b"), "n"))).alias("s")).select(
        "s.*").groupBy("a", "b").agg(F.max("n").alias("most"))
    free = F.col("most").isNull() | (often * F.col("most").cast("decimal(20,0)") < most * F.col("n").cast("decimal(20,0)"))

    two = pairs.join(above_pairs, ["a", "b"], "left").filter(free).select(
        "lang", F.concat_ws(" ", "wa", "wb").alias("phrase"), "n", _lowest(F.col("n"), [(F.col("na"), F.col("nb"))]).alias("cut"))
    c = F.col
    three = nodes.join(above_nodes, ["a", "b", "c"], "left").filter(free).join(pair("a", "b"), ["a", "b"]).join(
        pair("b", "c").select("b", "c", "nbc", "wc", "nc"), ["b", "c"]).select(
        c("langa").alias("lang"), F.concat_ws(" ", "wa", "wb", "wc").alias("phrase"), "n",
        _lowest(c("n"), [(c("na"), c("nbc")), (c("nab"), c("nc"))]).alias("cut"))
    windows = paths.select(F.explode(F.transform("weights", lambda n, i: F.struct(
        *[F.get("words", i + k).alias(x) for k, x in enumerate("abcd")], n.alias("n"),
        F.get("flows", i).alias("nabc"), F.get("flows", i + 1).alias("nbcd")))).alias("s")).select("s.*")
    four = windows.join(pair("a", "b"), ["a", "b"]).join(pair("c", "d"), ["c", "d"]).select(
        c("langa").alias("lang"), F.concat_ws(" ", "wa", "wb", "wc", "wd").alias("phrase"), "n",
        _lowest(c("n"), [(c("na"), c("nbcd")), (c("nab"), c("ncd")), (c("nabc"), c("nd"))]).alias("cut"))
    return two.unionByName(three).unionByName(four)


def collocations(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", least: int = LEAST, top: int = TOP,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n (all word occurrences), score.

    Highest score first, then the more frequent, then by the bytes of the phrase.  Words are what stands
    between spaces and tabs, pieces end at ``.,;:!?`` and line ends, A-Z are lowered.  Null languages are
    ``und``, null and empty texts have no words, repeated rows count each time; no documents give no rows.
    """
    parts = graph(docs, lang_column, text_column, least, block_words)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    rows = candidates(parts).select("lang", "phrase", F.col("n").alias("a"), "cut.score", "cut.l", "cut.r")
    kept = rows.withColumn("rank", rank).filter(F.col("rank") <= top)
    return kept.join(parts["totals"].withColumnRenamed("total", "n"), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
