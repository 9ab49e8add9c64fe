"""Scans, sources and sinks (S01-S19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators import audits as A
from rankweave.operators import metrics as M
from rankweave.operators import pools as P
from rankweave.plans import views as V
from rankweave.plans.registry import Tables, cte, query
from rankweave.session import shared_dir
from rankweave.sources import commit as CM
from rankweave.sources import keyed as KT
from rankweave.sources import candidates as C
from rankweave.sources import results as R


def candidate_lines(t: Tables, shift: int = 0) -> DataFrame:
    """Candidate records as JSON text, with every kind of fault at a fixed rate."""
    kind = (F.col("l_orderkey") + F.col("l_partkey") + F.col("l_linenumber") + shift) % 50
    reactant = F.concat(F.lit("r"), F.col("l_partkey") % 7, F.lit(" . s"), F.col("l_suppkey") % 5)
    head = F.concat(F.lit('{"product":"P'), "l_orderkey", F.lit('","reactant":"'))
    good = F.concat(head, reactant, F.lit('","prior":'), F.col("l_quantity").cast("int"), F.lit("}"))
    value = (
        F.when(kind == 0, "  ").when(kind == 1, '{"product":').when(kind == 2, "[1, 2]")
        .when(kind == 3, F.concat(head, reactant, F.lit('"}')))
        .when(kind == 4, F.concat(head, reactant, F.lit('","prior":"high"}')))
        .when(kind == 5, F.concat(head, reactant, F.lit('","prior":"nan"}')))
        .when(kind == 6, F.concat(F.lit('{"product":" ","reactant":"'), reactant, F.lit('","prior":1}')))
        .when(kind == 7, F.concat(head, F.lit(' . ","prior":1}'))).otherwise(good)
    )
    line = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_suppkey"))
    return t.lineitem.select(value.alias("value"), line.alias("line_no"))


cte("cand_lines", """
SELECT k, lower('p' || l_orderkey) AS product_key, 'P' || l_orderkey AS raw_product,
  'r' || (l_partkey % 7) || ' . s' || (l_suppkey % 5) AS raw_reactant,
  'r' || (l_partkey % 7) || '.s' || (l_suppkey % 5) AS cand_key, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS prior,
  (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey AS line_no
FROM (SELECT *, (l_orderkey + l_partkey + l_linenumber) % 50 AS k FROM lineitem)""")
cte("cand_ok", "SELECT * FROM cand_lines WHERE k > 7")


@query("s01_load_reactions", """
SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE query_id % 11 <> 0 AND query_id % 13 <> 0) AS usable,
  count(DISTINCT CASE WHEN query_id % 11 <> 0 THEN cluster_key END) AS n_products,
  count(class) FILTER (WHERE query_id % 3 <> 0) AS with_class
FROM plain_qs GROUP BY split""")
def s01(t: Tables):
    """Query rows with keys, metadata and a usability flag."""
    q = V.plain_queries(t)
    source = q.select(
        F.col("query_id").alias("id"), F.col("split").alias("set"),
        F.when(F.col("query_id") % 11 == 0, " ").otherwise(F.concat(F.lit("C"), "cluster_key")).alias("products_smiles"),
        F.when(F.col("query_id") % 13 == 0, F.lit(None)).otherwise("b . a").alias("reactants_smiles"))
    meta = q.filter(F.col("query_id") % 3 != 0).select(
        F.col("query_id").alias("reaction_id"), F.col("split").alias("source_split"),
        F.col("class").alias("reaction_class"))
    return C.load_reactions(source, meta).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("usable").alias("usable"),
        F.count_distinct("product_key").alias("n_products"), F.count("reaction_class").alias("with_class"))


@query("s02_tolerant_scan", """
SELECT count(*) FILTER (WHERE k <> 0) AS lines, count(*) FILTER (WHERE k IN (1, 2)) AS malformed,
  count(*) FILTER (WHERE k BETWEEN 3 AND 7) AS invalid, count(*) FILTER (WHERE k > 7) AS kept FROM cand_lines""")
def s02(t: Tables):
    """Audit of the tolerant candidate scan."""
    return C.tolerant_audit(C.classify(candidate_lines(t)))


@query("s02_tolerant_lists", """
SELECT product_key AS query_id, cand_key, max(prior) AS prior, row_number() OVER (
  PARTITION BY product_key ORDER BY max(prior) DESC, min(line_no), cand_key) AS rank
FROM cand_ok GROUP BY product_key, cand_key""")
def s02_lists(t: Tables):
    """Lists built from the accepted lines."""
    pool = P.dedupe(C.accepted(C.classify(candidate_lines(t))))
    return P.full_list(pool).select("query_id", "cand_key", "prior", "rank")


@query("s03_strict_audit", """
SELECT count(*) AS physical_lines, count(*) FILTER (WHERE k = 0) AS blank_lines,
  count(*) FILTER (WHERE k >= 6) AS candidate_records, count(*) FILTER (WHERE k IN (1, 2)) AS malformed_json_lines,
  count(*) FILTER (WHERE k = 3) AS missing_required_fields, count(*) FILTER (WHERE k = 4) AS invalid_prior_records,
  count(*) FILTER (WHERE k = 5) AS nonfinite_prior_records, count(*) FILTER (WHERE k = 6) AS invalid_product_records,
  count(*) FILTER (WHERE k = 7) AS invalid_reactant_records,
  count(*) FILTER (WHERE k > 7) - count(DISTINCT CASE WHEN k > 7 THEN product_key || '/' || cand_key END) AS canonical_duplicate_records,
  count(DISTINCT CASE WHEN k > 7 THEN product_key END) AS unique_products,
  count(DISTINCT CASE WHEN k > 7 THEN product_key || '/' || cand_key END) AS unique_candidates FROM cand_lines""")
def s03(t: Tables):
    """Twelve counters of the strict candidate scan."""
    return C.scan_audit(C.classify(candidate_lines(t)))


@query("s03_rejected_records", """
SELECT line_no, CASE WHEN k = 6 THEN 'invalid_product' ELSE 'invalid_reactant' END AS status,
  CASE WHEN k = 6 THEN NULL ELSE product_key END AS product_key, CASE WHEN k = 6 THEN ' ' ELSE raw_product END AS raw_product,
  CASE WHEN k = 7 THEN ' . ' ELSE raw_reactant END AS raw_reactant, 1.0::DOUBLE AS prior FROM cand_lines WHERE k IN (6, 7)""")
def s03_rejected(t: Tables):
    """Records rejected for their keys, with their raw text."""
    return C.rejected(C.classify(candidate_lines(t)))


@query("s03_fatal_errors", """
SELECT line_no, CASE k WHEN 1 THEN 'malformed_json' WHEN 2 THEN 'non_object_json' WHEN 3 THEN 'missing_required_fields'
  WHEN 4 THEN 'invalid_prior' ELSE 'nonfinite_prior' END AS status FROM cand_lines WHERE k BETWEEN 1 AND 5""")
def s03_fatal(t: Tables):
    """Lines that make the file unusable."""
    return C.fatal(C.classify(candidate_lines(t)))


@query("s04_labelled_lists", """
SELECT product, reactant, prior, label, row_number() OVER (PARTITION BY product ORDER BY prior DESC, line_no, reactant) - 1 AS rank,
  count(*) OVER (PARTITION BY product) AS n FROM (
  SELECT 'P' || l_orderkey AS product, 'R' || l_partkey AS reactant, l_quantity AS prior,
    CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END AS label,
    CAST(l_linenumber AS BIGINT) * 10000000000 + l_suppkey AS line_no FROM lineitem WHERE l_suppkey % 9 <> 0)""")
def s04(t: Tables):
    """Labelled rows grouped by raw product with a 0-based rank."""
    blank = F.col("l_suppkey") % 9 == 0
    rows = t.lineitem.select(
        F.concat(F.lit("P"), "l_orderkey").alias("product"),
        F.when(blank, "").otherwise(F.concat(F.lit("R"), "l_partkey")).alias("reactant"),
        F.col("l_quantity").alias("prior"), (F.col("l_discount") >= 0.09).cast("int").alias("label"),
        (F.col("l_linenumber").cast("long") * 10000000000 + F.col("l_suppkey")).alias("line_no"))
    return C.labelled_lists(rows).select("product", "reactant", "prior", "label", "rank", "n")


@query("s05_predictions_per_seed", """
SELECT seed, count(*) AS n, count(DISTINCT query_id) AS n_ids, CAST(sum(rank) AS BIGINT) AS rank_sum
FROM ranks_historical WHERE arm = 'augmented' GROUP BY seed""")
def s05(t: Tables):
    """Rank rows written as one CSV folder per seed and read back in one scan."""
    path = shared_dir(t.spark)
    wide = V.wide_ranks(t, "historical")
    long = wide.select("query_id", F.explode(F.array(*[
        F.struct(F.lit(f"seed_{s}").alias("file"), F.col(f"augmented_{s}").alias("rank")) for s in V.SEEDS]))
        .alias("c")).select("query_id", "c.rank", "c.file")
    long.write.partitionBy("file").option("header", "true").csv(path)
    rows = R.read_predictions(t.spark, f"{path}/*", "query_id LONG, rank LONG")
    return rows.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("n_ids"), F.sum("rank").alias("rank_sum"))


@query("s06_unpivot_ranks", """
SELECT query_id, arm, seed, rank FROM ranks_historical WHERE split = 'test'""")
def s06(t: Tables):
    """Wide per-seed ranks to rows, for the requested ids."""
    ids = V.plain_queries(t).filter(F.col("split") == "test").select("query_id")
    return R.unpivot_ranks(V.wide_ranks(t, "historical"), ids)


@query("s07_target_prefix", """
SELECT query_id, cand_key, rank FROM pool_alpha WHERE rank <= 10
  AND query_id IN (SELECT query_id FROM plain_qs WHERE class = '1-URGENT')""")
def s07(t: Tables):
    """First ten stored rows of the target queries."""
    targets = V.plain_queries(t).filter(F.col("class") == "1-URGENT").select("query_id")
    return C.target_prefix(V.lists(t, "alpha"), targets).select("query_id", "cand_key", "rank")


def encoded_cells(t: Tables) -> DataFrame:
    """One line of tab-separated cells per query (lists of at most ten)."""
    cell = F.when(F.col("cand_key") % 17 == 0, "?").otherwise(
        F.concat(F.lit("('t"), F.col("cand_key") % 40, F.lit("', "),
                 F.col("prior").cast("int").cast("string"), F.lit(")")))
    return V.lists(t, "beta").groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", cell.alias("cell")))), lambda x: x["cell"]), "\t").alias("value"))


@query("s08_decoded_lists", """
SELECT query_id, cand_key, score, pos, rank, 1.0::DOUBLE - (rank - 1) / greatest(n - 1, 1) AS prior FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank, least(5, count(*) OVER (PARTITION BY query_id)) AS n FROM (
    SELECT query_id, 't' || (cand_key % 40) AS cand_key, CAST(CAST(prior AS INTEGER) AS DOUBLE) AS score, CAST(rank - 1 AS INTEGER) AS pos,
      row_number() OVER (PARTITION BY query_id, cand_key % 40 ORDER BY prior DESC, rank) AS rn
    FROM top_beta WHERE cand_key % 17 <> 0) WHERE rn = 1) WHERE rank <= 5""")
def s08(t: Tables):
    """Decode cells, keep the best per identity, cut at five."""
    return C.decode_cells(encoded_cells(t), 5).select("query_id", "cand_key", "score", "pos", "rank", "prior")


@query("s08_decode_audit", """
SELECT count(*) AS cells, count(*) FILTER (WHERE cand_key % 17 = 0) AS invalid_cells FROM top_beta""")
def s08_audit(t: Tables):
    """Cells read and cells dropped."""
    return C.decode_audit(encoded_cells(t))


@query("s09_inventory", """
SELECT l_partkey AS part, row_number() OVER (ORDER BY min(l_orderkey * 10 + l_linenumber), l_partkey) - 1 AS product_rank,
  min(l_orderkey * 10 + l_linenumber) AS first_seen FROM lineitem GROUP BY l_partkey""")
def s09(t: Tables):
    """Distinct items in first-seen order."""
    rows = t.lineitem.select(F.col("l_partkey").alias("part"),
                             (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return C.inventory(rows, "part", "line")


@query("s10_inspect", """
WITH ids AS (SELECT arg_max(o_orderkey, o_totalprice) AS query_id FROM orders GROUP BY o_orderpriority)
SELECT w.query_id, w.truth_key, w.prior_rank, w.list_len, w.baseline_42, w.augmented_42, t.cand_key, t.rank, round(t.prior, 6) AS prior
FROM wide_historical w JOIN ids USING (query_id) JOIN top_historical t ON t.query_id = w.query_id""")
def s10(t: Tables):
    """Everything known about the largest order of each class: lists and ranks."""
    ids = t.orders.groupBy("o_orderpriority").agg(F.max_by("o_orderkey", "o_totalprice").alias("query_id")).select("query_id")
    wide = V.wide_ranks(t, "historical", (42,)).join(ids, "query_id", "left_semi")
    lists = V.lists(t, "historical").select("query_id", "cand_key", "rank", F.round("prior", 6).alias("prior"))
    return wide.select("query_id", "truth_key", "prior_rank", "list_len", "baseline_42", "augmented_42").join(lists, "query_id")


@query("s10_keyed_lists", """
WITH ids AS (SELECT arg_max(o_orderkey, o_totalprice) AS query_id FROM orders GROUP BY o_orderpriority)
SELECT t.query_id, t.cand_key, t.rank, round(t.prior, 6) AS prior FROM top_historical t JOIN ids USING (query_id)""")
def s10_keyed(t: Tables):
    """Lists of the largest order of each class, looked up in a table laid out by key."""
    lists = V.lists(t, "historical").select("query_id", "cand_key", "rank", F.round("prior", 6).alias("prior"))
    stored = KT.read_keyed(t.spark, KT.write_keyed(lists, "query_id"), lists.schema)
    ids = t.orders.groupBy("o_orderpriority").agg(F.max_by("o_orderkey", "o_totalprice").alias("query_id")).select("query_id")
    return KT.lookup_keys(stored, "query_id", ids)


@query("s11_cohort_scan", """
SELECT pool, count(*) AS n_rows, count(DISTINCT query_id) AS n_ids, true AS unique_ids, count(DISTINCT cluster_key) AS n_clusters
FROM (SELECT pool, query_id, cluster_key FROM wide_historical WHERE prior_rank > 0 UNION ALL
  SELECT pool, query_id, cluster_key FROM wide_beta WHERE prior_rank > 0) GROUP BY pool""")
def s11(t: Tables):
    """Cohort of one pool with its uniqueness checks."""
    both = V.wide_ranks(t, "historical", (42,)).unionByName(V.wide_ranks(t, "beta", (42,)))
    covered = both.filter(F.col("prior_rank") > 0)
    return covered.groupBy("pool").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("query_id").alias("n_ids"),
        (F.count(F.lit(1)) == F.count_distinct("query_id")).alias("unique_ids"),
        F.count_distinct("cluster_key").alias("n_clusters"))


@query("s12_prediction_sink", """
SELECT w.query_id, prior_rank AS rank, CASE WHEN prior_rank = 1 THEN 1 ELSE 0 END AS hit_1,
  CASE WHEN prior_rank BETWEEN 1 AND 3 THEN 1 ELSE 0 END AS hit_3, CASE WHEN prior_rank BETWEEN 1 AND 5 THEN 1 ELSE 0 END AS hit_5,
  CASE WHEN prior_rank BETWEEN 1 AND 10 THEN 1 ELSE 0 END AS hit_10,
  round(CASE WHEN prior_rank > 0 THEN 1.0::DOUBLE / prior_rank ELSE 0 END, 6) AS rr, l.items[1] AS top1,
  '["' || array_to_string(l.items, '","') || '"]' AS candidates_json
FROM wide_historical w JOIN (SELECT query_id, list(CAST(cand_key AS VARCHAR) ORDER BY rank) AS items FROM top_historical GROUP BY query_id) l
  ON l.query_id = w.query_id""")
def s12(t: Tables):
    """Flat prediction rows written as JSON lines and read back."""
    lists = V.lists(t, "historical")
    ranks = P.truth_position(V.queries(t), lists).join(lists.select("query_id").distinct(), "query_id", "left_semi")
    rows = R.prediction_rows(lists, ranks.select("query_id", "rank"))
    path = shared_dir(t.spark)
    R.write_records(rows, path, "json")
    return V.rounded(t.spark.read.schema(rows.schema).json(path))


@query("s12_committed_sink", """
SELECT count(*) AS manifest_rows, count(*) AS stored_rows, true AS second_write_refused, CAST(sum(rank) AS BIGINT) AS rank_sum FROM top_beta""")
def s12_committed(t: Tables):
    """Lists written once with a manifest, read back against it; a second write to the same place is refused."""
    lists, path = V.lists(t, "beta").select("query_id", "cand_key", "rank"), shared_dir(t.spark)
    manifest = CM.write_once(lists, path)
    try:
        CM.write_once(lists, path)
        refused = False
    except FileExistsError:
        refused = True
    stored = CM.read_once(t.spark, path, lists.schema)
    return stored.agg(F.count(F.lit(1)).alias("stored_rows"), F.sum("rank").alias("rank_sum")).select(
        F.lit(manifest["rows"]).cast("long").alias("manifest_rows"), "stored_rows", F.lit(refused).alias("second_write_refused"), "rank_sum")


@query("s13_feature_shards", """
SELECT query_id // 500 AS shard, min(query_id) AS first_key, max(query_id) AS last_key, count(DISTINCT query_id) AS n_keys,
  count(*) AS n_rows, coalesce(lead(min(query_id)) OVER (ORDER BY query_id // 500) = max(query_id) + 1, true) AS contiguous
FROM (SELECT q.query_id FROM plain_qs q LEFT JOIN top_alpha a ON a.query_id = q.query_id) GROUP BY query_id // 500""")
def s13(t: Tables):
    """Write query ranges as shards, then merge with range checks."""
    rows = V.plain_queries(t).select("query_id").join(V.lists(t, "alpha"), "query_id", "left")
    path = shared_dir(t.spark)
    R.write_shards(rows, path, "query_id", 500)
    merged = t.spark.read.schema("query_id LONG, cand_key LONG, prior DOUBLE, shard LONG").parquet(path)
    return R.shard_ranges(merged, "query_id")


@query("s14_selection_export", """
SELECT 'train_pairs' AS part, count(*) AS n_rows, count(DISTINCT query_id) AS n_queries FROM train_pairs
UNION ALL SELECT 'validation', count(*), count(DISTINCT t.query_id) FROM top_historical t JOIN plain_qs q USING (query_id) WHERE split = 'valid'
UNION ALL SELECT 'validation_matches', count(*), count(DISTINCT t.query_id) FROM top_historical t JOIN qs q USING (query_id)
  WHERE split = 'valid' AND cand_key = truth_key""")
def s14(t: Tables):
    """Training pairs and validation rows, exported without any test answer."""
    from rankweave.plans.pairs import labelled_lists, train_pairs
    pairs, path = train_pairs(t), shared_dir(t.spark)
    valid = labelled_lists(t).filter(F.col("split") == "valid").select("query_id", "cand_key", "rank", "is_match")
    R.write_records(pairs, f"{path}/pairs")
    R.write_records(valid, f"{path}/validation")
    read = t.spark.read
    pairs = read.schema(pairs.schema).parquet(f"{path}/pairs").select(F.lit("train_pairs").alias("part"), "query_id")
    stored = read.schema(valid.schema).parquet(f"{path}/validation")
    rows = pairs.unionByName(stored.select(F.lit("validation").alias("part"), "query_id")).unionByName(
        stored.filter("is_match").select(F.lit("validation_matches").alias("part"), "query_id"))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("query_id").alias("n_queries"))


@query("s15_vector_lookup", """
SELECT l.source, count(*) AS n_keys, count(*) FILTER (WHERE e.vec_id IS NOT NULL AND l.doc_id % 11 <> 0) AS hits,
  count(*) FILTER (WHERE e.vec_id IS NOT NULL AND l.doc_id % 11 = 0) AS failed, count(*) FILTER (WHERE e.vec_id IS NULL) AS missing
FROM documents l LEFT JOIN embeddings e ON e.vec_id = l.doc_id GROUP BY l.source""")
def s15(t: Tables):
    """Keyed vector lookup that tells missing from failed."""
    vectors = t.embeddings.select(
        F.col("vec_id").alias("key"), F.when(F.col("vec_id") % 11 != 0, F.col("embedding")).alias("vec"))
    looked = A.lookup(t.documents.select(F.col("doc_id").alias("key"), "source"), vectors, "key", "vec")
    return A.lookup_counts(looked, ["source"])


@query("s16_nested_metrics", """
SELECT arm, 'within' AS scope, metric, count(*) AS n_seeds, round(avg(v), 6) AS mean FROM (
  SELECT arm, seed, 'top1' AS metric, avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END) AS v FROM ranks_historical WHERE prior_rank > 0 GROUP BY arm, seed
  UNION ALL SELECT arm, seed, 'mrr', avg(1.0::DOUBLE / rank) FROM ranks_historical WHERE prior_rank > 0 GROUP BY arm, seed) GROUP BY arm, metric""")
def s16(t: Tables):
    """Metrics per arm from a nested JSON record, averaged over seeds."""
    per_seed = M.ranking_metrics(V.ranks(t).filter(F.col("prior_rank") > 0), ["arm", "seed"], (1,))
    leaf = F.create_map(F.lit("top1"), "top1", F.lit("mrr"), "mrr")
    by_seed = per_seed.select("arm", F.struct(F.col("seed").cast("string"), F.create_map(F.lit("within"), leaf)).alias("e"))
    by_arm = by_seed.groupBy("arm").agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    record = by_arm.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("arm", "m")))).alias("record"))
    return V.rounded(R.nested_metrics(record, "record").groupBy("arm", "scope", "metric").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("value").alias("mean")))


@query("s17_tidy_effects", """
SELECT 'by_class' AS source, class AS label, round(avg(d_mrr), 6) AS effect, round(min(d_mrr), 6) AS low, round(max(d_mrr), 6) AS high FROM effects_historical GROUP BY class
UNION ALL SELECT 'by_seed', CAST(seed AS VARCHAR), round(avg(d_mrr), 6), round(min(d_mrr), 6), round(max(d_mrr), 6) FROM effects_historical GROUP BY seed
UNION ALL SELECT 'by_split', split, round(avg(d_mrr), 6), round(min(d_mrr), 6), round(max(d_mrr), 6) FROM effects_historical GROUP BY split""")
def s17(t: Tables):
    """Three result tables with different column names as one tidy table."""
    rows = V.effects(t)
    parts = []
    for source, column, names in (("by_class", "class", ("eff", "lo", "hi")), ("by_seed", "seed", ("delta", "p0", "p100")),
                                  ("by_split", "split", ("mean", "least", "most"))):
        table = rows.groupBy(F.col(column).cast("string").alias("label")).agg(
            F.avg("d_mrr").alias(names[0]), F.min("d_mrr").alias(names[1]), F.max("d_mrr").alias(names[2])
        ).withColumn("source", F.lit(source))
        parts.append((table, {"source": "source", "label": "label", "effect": names[0], "low": names[1], "high": names[2]}))
    return V.rounded(R.tidy_effects(parts))


@query("s18_lists_from_json", """
SELECT query_id, CAST(cand_key AS VARCHAR) AS cand_key, rank, n, round(1.0::DOUBLE - (rank - 1) / greatest(n - 1, 1), 6) AS prior FROM top_beta""")
def s18(t: Tables):
    """Lists rebuilt from a JSON array column."""
    lists = V.lists(t, "beta")
    rows = R.prediction_rows(lists, lists.groupBy("query_id").agg(F.max("n").alias("rank")))
    return V.rounded(C.lists_from_json(rows, "candidates_json"))


@query("s19_replicate_grid", """
SELECT replicate, seed, count(*) AS n, CAST(sum(query_id) AS BIGINT) AS id_sum, round(avg(replicate * d_mrr), 6) AS gain
FROM effects_historical, (SELECT unnest([1, 2, 3, 4, 5]) AS replicate) GROUP BY replicate, seed""")
def s19(t: Tables):
    """Replicate by seed cells against the shared baseline of each seed."""
    rows = V.effects(t)
    base = rows.select("seed", "query_id", F.round(1 / F.col("base_rank"), 12).alias("base_value"))
    cells = rows.select("seed", "query_id", F.explode(F.array(*[F.struct(
        F.lit(r).alias("replicate"), (F.round(1 / F.col("base_rank"), 12) + r * F.col("d_mrr")).alias("cell_value"))
        for r in range(1, 6)])).alias("c")).select("seed", "query_id", "c.*")
    return V.rounded(R.grid_cells(cells, base).groupBy("replicate", "seed").agg(
        F.count(F.lit(1)).alias("n"), F.sum("query_id").alias("id_sum"), F.avg("value").alias("gain")))
