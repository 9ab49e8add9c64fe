"""Removal of repeated runs of lines, with DataFrame functions only.

Every run of ``width`` consecutive lines is hashed.  Of runs that occur more than once anywhere, the
occurrence with the smallest (document id, line number) stays; all others are marked.  A line goes when
any marked run covers it, so overlapping runs merge into one removed passage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import identity, pack, unpack


def line_windows(docs: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """One row per run of lines: (h1, h2) its 128-bit hash, ``at`` its place (id, _a, _b, pos)."""
    key = pack(docs).select(
        F.col("row")[id_column].alias("id"), *identity(F.col("row")[id_column], F.col("row")[text_column]),
        F.split(F.col("row")[text_column], "\n").alias("lines"))
    shifted = [F.slice("lines", i + 1, F.greatest(F.size("lines"), F.lit(1))).alias(f"l{i}") for i in range(width)]
    runs = key.select("id", "_a", "_b", F.posexplode(F.arrays_zip(*shifted)).alias("pos", "run"))
    parts = [F.col("run")[f"l{i}"] for i in range(width)]
    full = runs.filter(parts[-1].isNotNull() & F.concat(*parts).rlike("[^ \\t\\r]"))
    return full.select(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"),
                       F.struct("id", "_a", "_b", "pos").alias("at"))


def repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """Places of repeated runs that are not the first: one row (_a, _b, starts) per document that has any.

    First places are found with map-side partial aggregation; the join back can be split by AQE, so one
    run that holds a large part of all rows is spread.
    """
    windows = line_windows(docs, id_column, text_column, width)
    first = windows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = windows.join(first, ["h1", "h2"]).filter(F.col("at") != F.col("first"))
    return later.select("at.*").groupBy("_a", "_b").agg(F.collect_set("pos").alias("starts"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """Documents without the lines of repeated runs, plus ``n_lines`` and ``n_removed`` (long).

    Lines end at ``\\n`` alone.  Documents with fewer than ``width`` lines, and runs of blank lines only,
    never count.  Null texts stay null with zero lines; an empty text is one empty line.  Rows that repeat
    both id and text are one document stated twice and stay alike.  A null id sorts first.  If all lines
    go, the text is empty and the row stays.
    """
    marks = repeated_lines(docs, id_column, text_column, width)
    text = F.col("row")[text_column]
    base = pack(docs).select("row", *identity(F.col("row")[id_column], text))
    joined = base.join(marks.hint("shuffle_hash"), ["_a", "_b"], "left")
    split = joined.withColumn("lines", F.split(text, "\n"))
    covered = F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (width - 1))))
    kept = split.withColumn("kept", F.when(F.col("starts").isNotNull(), F.array_except(
        F.sequence(F.lit(0), F.size("lines") - 1), covered)))
    lines = F.when(text.isNull(), 0).otherwise(F.size("lines"))
    return unpack(kept, docs.columns, **{
        text_column: F.when(F.col("kept").isNull(), text).otherwise(
            F.array_join(F.transform("kept", lambda i: F.get(F.col("lines"), i)), "\n")),
        "n_lines": lines.cast("long"),
        "n_removed": F.when(F.col("kept").isNull(), 0).otherwise(lines - F.size("kept")).cast("long"),
    })
