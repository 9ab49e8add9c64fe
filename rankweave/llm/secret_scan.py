"""Secret scanning with an incremental blob ledger.

Every version of every file is addressed by the SHA-256 of its text.  The ledger holds the findings per
(blob, rule version); a run scans the blobs it lacks, each once however many paths or versions share it,
and joins findings back to all of them.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import materialise, pack, unpack

# Raise it with every change of the rules: the ledger then counts no blob as seen.
RULES_VERSION = 1

# The three base kinds, in the order that breaks ties.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18

FINDING = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """(start, end) code points of each kind: leftmost matches that do not overlap, then those long enough."""
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE],
        "access": [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def joined(found: dict[str, list[tuple[int, int]]]) -> str:
    """``kind:start:end`` by start, then kind in the order of KINDS."""
    rows = sorted((start, KINDS.index(kind), end) for kind, spans in found.items() for start, end in spans)
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in rows)


def _scan(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts.to_pylist():
        found = find(text)
        spans = joined(found)
        rows.append({**{f"n_{kind}": len(found[kind]) for kind in KINDS},
                     "base_sha256": hashlib.sha256(spans.encode()).hexdigest(), "spans": spans})
    return pa.array(rows, pa.struct([*[(f"n_{kind}", pa.int64()) for kind in KINDS],
                                     ("base_sha256", pa.string()), ("spans", pa.string())]))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], f"blob string, rules int, {FINDING}")


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, text_column: str = "text",
                  rules: int = RULES_VERSION) -> DataFrame:
    """The ledger with the blobs of ``versions`` it lacked; written once.

    Blobs are made single inside each task before they are shuffled, so one blob under very many paths
    moves once per task.  The rest of the ledger, other rule versions too, stays.
    """
    text = F.coalesce(F.col("row")[text_column], F.lit(""))
    blobs = pack(versions).select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    apply = F.arrow_udf(_scan, FINDING).asNondeterministic()
    scanned = unseen.withColumn("found", apply("text")).select("blob", F.lit(rules).alias("rules"), "found.*")
    return materialise(scanned if ledger is None else ledger.unionByName(scanned))


def scan(versions: DataFrame, ledger: DataFrame | None = None, text_column: str = "text",
         rules: int = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """(``versions`` with ``blob`` and findings, updated ledger).

    Added columns: ``n_assign``, ``n_access``, ``n_hex`` (long), ``base_sha256`` (of the joined spans) and
    ``spans`` (empty string if none).  A null text counts as empty.  Every path and version keeps its row.
    """
    ledger = update_ledger(versions, ledger, text_column, rules)
    known = ledger.filter(F.col("rules") == rules).drop("rules")
    addressed = pack(versions, blob=F.sha2(F.coalesce(F.col("row")[text_column], F.lit("")), 256))
    names = [n.split()[0] for n in FINDING.split(", ")]
    out = addressed.join(known, "blob")
    return unpack(out, versions.columns, **{c: F.col(c) for c in ("blob", *names)}), ledger
