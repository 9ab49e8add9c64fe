"""Streaming ingest (ST1, ST2), driven to completion over files made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.plans import views as V
from rankweave.plans.registry import Tables, query
from rankweave.session import shared_dir
from rankweave.streaming import ingest as I

SCHEMA = "query_id LONG, cand_key LONG, prior DOUBLE, line_no LONG"


def chunk_files(t: Tables) -> str:
    """Candidate lines as a folder of files, as a generator would leave them."""
    path = shared_dir(t.spark)
    lines = V.raw_lines(t, "beta").select(
        "query_id", F.when(F.col("cand_key") % 23 != 0, F.col("cand_key")).alias("cand_key"),
        F.when(F.col("cand_key") % 29 == 0, -F.col("prior")).otherwise(F.col("prior")).alias("prior"), "line_no")
    lines.repartition("query_id", "cand_key").write.parquet(path)
    return path


@query("st1_incremental_ingest", """
SELECT query_id, cand_key, max(prior) AS prior, min(line_no) AS first_seen, count(*) AS copies FROM raw_beta WHERE cand_key % 23 <> 0 AND cand_key % 29 <> 0 GROUP BY ALL""")
def st1(t: Tables):
    """Files ingested in micro-batches; the pool does not depend on their order."""
    work = shared_dir(t.spark)
    I.ingest_files(t.spark, chunk_files(t), f"{work}/table", f"{work}/checkpoint", SCHEMA)
    return I.ingested_pool(t.spark, f"{work}/table", SCHEMA).select("query_id", "cand_key", "prior", "first_seen", "copies")


@query("st1_status_counts", """
SELECT CASE WHEN cand_key % 23 = 0 THEN 'empty' WHEN cand_key % 29 = 0 THEN 'policy_error' ELSE 'ok' END AS status, count(*) AS n FROM raw_beta GROUP BY 1""")
def st1_status(t: Tables):
    """Status of every ingested line."""
    work = shared_dir(t.spark)
    I.ingest_files(t.spark, chunk_files(t), f"{work}/table", f"{work}/checkpoint", SCHEMA)
    return I.status_counts(t.spark, f"{work}/table", SCHEMA)


@query("st2_running_winners", """
SELECT query_id, CASE WHEN cand_key % 23 <> 0 THEN cand_key END AS cand_key, max(CASE WHEN cand_key % 29 = 0 THEN -prior ELSE prior END) AS prior, min(line_no) AS first_seen, count(*) AS copies FROM raw_beta GROUP BY 1, 2""")
def st2(t: Tables):
    """Running winners per key, whose state is a table by batch version."""
    work = shared_dir(t.spark)
    I.run_winners(t.spark, chunk_files(t), f"{work}/winners", f"{work}/checkpoint", SCHEMA)
    return I.latest_winners(t.spark, f"{work}/winners")
