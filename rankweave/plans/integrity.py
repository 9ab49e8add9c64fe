"""Integrity and reproducibility audits (Q01-Q16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions import keys as K
from rankweave.operators import audits as A
from rankweave.operators import pairs as X
from rankweave.operators import pools as P
from rankweave.plans import views as V
from rankweave.plans.aggregations import descriptors
from rankweave.plans.joins import thinned_pool
from rankweave.plans.pairs import multi_labelled
from rankweave.plans.registry import Tables, cte, query
from rankweave.plans.scans import candidate_lines
from rankweave.session import materialise
from rankweave.sources import candidates as C

cte("cand_lines_b", """
SELECT k, lower('p' || l_orderkey) AS product_key, 'r' || (l_partkey % 7) || '.s' || (l_suppkey % 5) AS cand_key, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS prior,
  (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey AS line_no FROM (SELECT *, (l_orderkey + l_partkey + l_linenumber + 7) % 50 AS k FROM lineitem)""")
for _side, _source in (("a", "cand_lines"), ("b", "cand_lines_b")):
    cte(f"cmp_{_side}", f"""
SELECT product_key, cand_key, max(prior) AS prior, row_number() OVER (PARTITION BY product_key ORDER BY max(prior) DESC, min(line_no), cand_key) AS rank,
  min(line_no) AS first_seen FROM {_source} WHERE k > 7 GROUP BY product_key, cand_key""")
    cte(f"place_{_side}", f"SELECT product_key, row_number() OVER (ORDER BY min(first_seen), product_key) AS place FROM cmp_{_side} GROUP BY product_key")
cte("cmp_issues", """
SELECT coalesce(a.product_key, b.product_key) AS query_id, CASE WHEN b.product_key IS NULL THEN 'missing_product' ELSE 'extra_product' END AS issue, CAST(NULL AS VARCHAR) AS cand_key
FROM place_a a FULL OUTER JOIN place_b b ON a.product_key = b.product_key WHERE a.product_key IS NULL OR b.product_key IS NULL
UNION ALL SELECT a.product_key, 'product_order_mismatch', NULL FROM place_a a JOIN place_b b USING (product_key) WHERE a.place <> b.place
UNION ALL SELECT a.product_key, 'candidate_identity_or_order_mismatch', NULL FROM (SELECT product_key, list(cand_key ORDER BY rank) AS i FROM cmp_a GROUP BY 1) a
  JOIN (SELECT product_key, list(cand_key ORDER BY rank) AS i FROM cmp_b GROUP BY 1) b USING (product_key) WHERE a.i <> b.i
UNION ALL SELECT a.product_key, 'prior_tolerance_exceeded', a.cand_key FROM cmp_a a JOIN cmp_b b USING (product_key, cand_key) WHERE abs(b.prior - a.prior) > greatest(1e-8, 1e-6 * abs(a.prior))
UNION ALL SELECT product_key, 'prior_order_inversion', cand_key FROM (SELECT a.product_key, a.cand_key, b.prior, lead(b.prior) OVER (PARTITION BY a.product_key ORDER BY a.rank) AS nxt
  FROM cmp_a a JOIN cmp_b b USING (product_key, cand_key)) WHERE prior < nxt""")


def two_files(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The same candidates as two text files with faults on different lines.

    Parsed once each and written: every check reads the parsed lines.
    """
    return tuple(materialise(C.classify(candidate_lines(t, shift)).drop("value")) for shift in (0, 7))


def ordered_pool(parsed: DataFrame) -> DataFrame:
    """Ordered pool of one parsed file, written because several checks read it."""
    pool = P.full_list(P.dedupe(C.accepted(parsed)))
    return materialise(pool.select("query_id", "cand_key", "prior", "first_seen", "rank"))


def two_pools(t: Tables) -> tuple[DataFrame, DataFrame]:
    return tuple(ordered_pool(parsed) for parsed in two_files(t))


@query("q01_pool_issues", "SELECT query_id, issue, cand_key FROM cmp_issues")
def q01(t: Tables):
    """Every difference between two candidate files, one row each."""
    return A.pool_issues(*two_pools(t))


@query("q01_comparison_summary", """
SELECT i.*, false AS audit_counts_exact, false AS reference_loads, false AS other_loads, false AS rejected_records_exact, false AS comparison_passed FROM (
  SELECT count(*) FILTER (WHERE issue IN ('missing_product', 'extra_product')) = 0 AS product_identity_exact,
    count(*) FILTER (WHERE issue IN ('missing_product', 'extra_product', 'product_order_mismatch')) = 0 AS product_order_exact,
    count(*) FILTER (WHERE issue IN ('candidate_identity_or_order_mismatch', 'missing_product')) = 0 AS identity_order_exact,
    count(*) FILTER (WHERE issue = 'prior_tolerance_exceeded') = 0 AS prior_tolerance_passed,
    count(*) FILTER (WHERE issue = 'prior_order_inversion') AS prior_inversion_count, count(DISTINCT query_id) AS discrepancy_product_count FROM cmp_issues) i""")
def q01_summary(t: Tables):
    """All checks of the comparison in one row."""
    a, b = two_files(t)
    issues = A.pool_issues(ordered_pool(a), ordered_pool(b))
    return A.comparison_summary(issues, (C.scan_audit(a), C.scan_audit(b)), (C.rejected(a), C.rejected(b)))


@query("q02_product_order", """SELECT product_key AS query_id, a.place AS reference_place, b.place AS other_place FROM place_a a JOIN place_b b USING (product_key) WHERE a.place <> b.place""")
def q02(t: Tables):
    """Queries whose first-seen position differs."""
    return A.product_order(*two_pools(t))


@query("q03_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q03(t: Tables):
    """Keys that should be unique and are not."""
    return A.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("q04_exact_pairing", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE a.query_id IS NULL OR b.query_id IS NULL OR a.{c} IS DISTINCT FROM b.{c}) AS n_differ,
  min(coalesce(a.query_id, b.query_id)) FILTER (WHERE a.query_id IS NULL OR b.query_id IS NULL OR a.{c} IS DISTINCT FROM b.{c}) AS first_key
  FROM wide_historical a FULL OUTER JOIN (SELECT * FROM wide_alpha WHERE query_id % 50 <> 3) b ON a.query_id = b.query_id""" for c in ("class", "list_len", "prior_rank")))
def q04(t: Tables):
    """Columns that must be identical in two rank tables."""
    a = V.wide_ranks(t, "historical", (42,))
    b = V.wide_ranks(t, "alpha", (42,)).filter(F.col("query_id") % 50 != 3)
    return A.pairing_report(a, b, "query_id", ["class", "list_len", "prior_rank"])


@query("q05_status_reconciliation", """
SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.status, b.status) AS status, coalesce(a.c, 0) AS counted, coalesce(b.c, 0) AS stored, coalesce(a.c, 0) = coalesce(b.c, 0) AS matches FROM (
  SELECT lang, CASE WHEN quality IS NULL THEN 'missing' WHEN quality = 1 THEN 'ok' ELSE 'low' END AS status, count(*) AS c FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL) a
FULL OUTER JOIN (SELECT lang, CASE WHEN quality = 1 THEN 'ok' ELSE 'low' END AS status, count(*) AS c FROM documents JOIN labels USING (doc_id) GROUP BY ALL) b ON a.lang = b.lang AND a.status = b.status""")
def q05(t: Tables):
    """Recounted status per group against stored counts."""
    label = t.labels.select("doc_id", "quality")
    status = F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 1, "ok").otherwise("low")
    rows = t.documents.select("doc_id", "lang").join(label, "doc_id", "left").withColumn("status", status)
    stored = t.documents.select("doc_id", "lang").join(label, "doc_id").withColumn("status", status).groupBy("lang", "status").agg(
        F.count(F.lit(1)).alias("stored"))
    return A.reconcile_status(rows, stored, ["lang"])


@query("q06_lookup_coverage", """
SELECT count(*) AS n_keys, count(*) FILTER (WHERE quality = 1) AS hits, count(*) FILTER (WHERE quality = 0) AS failed, count(*) FILTER (WHERE quality IS NULL) AS missing,
  round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END), 6) AS hit_rate FROM documents LEFT JOIN labels USING (doc_id)""")
def q06(t: Tables):
    """Hit rate of a lookup, with failed and missing apart."""
    table = t.labels.select("doc_id", F.when(F.col("quality") == 1, 1).alias("value"))
    counts = A.lookup_counts(A.lookup(t.documents.select("doc_id"), table, "doc_id", "value"), [])
    return V.rounded(counts.withColumn("hit_rate", F.col("hits") / F.col("n_keys")))


@query("q07_tolerance_check", """
SELECT class, abs(a - b) <= 1e-12 AS close FROM (SELECT class, avg(d_mrr) AS a, avg(d_mrr) + CASE WHEN class = '3-MEDIUM' THEN 1e-9 ELSE 0 END AS b FROM effects_historical GROUP BY class)""")
def q07(t: Tables):
    """Two result tables equal to 1e-12, name by name."""
    means = V.effects(t).groupBy("class").agg(F.avg("d_mrr").alias("value"))
    moved = means.withColumn("value", F.col("value") + F.when(F.col("class") == "3-MEDIUM", 1e-9).otherwise(0.0))
    return A.close_check(means, moved, ["class"], "value")


@query("q08_tie_aware_replay", """
WITH s AS (SELECT query_id, cand_key, feat, round(feat, 1) AS sc, rank FROM top_historical),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, feat, rank) AS old_rank, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, feat, rank DESC) AS new_rank FROM s),
b AS (SELECT query_id, feat, count(*) AS n, min(new_rank) AS lo, max(new_rank) AS hi, max(sc) - min(sc) AS span FROM o GROUP BY ALL)
SELECT CASE WHEN new_rank = old_rank THEN 'same' WHEN hi - lo + 1 = n AND span <= 1e-6 AND old_rank BETWEEN lo AND hi THEN 'tie' ELSE 'changed' END AS replay, count(*) AS n
FROM o JOIN b ON o.query_id = b.query_id AND o.feat = b.feat GROUP BY 1""")
def q08(t: Tables):
    """Changed ranks of a replay are accepted only among identical candidates."""
    from pyspark.sql.window import Window
    rows = V.lists(t, "historical").select("query_id", "cand_key", "feat", F.round("feat", 1).alias("score"), F.col("rank").alias("_r"))
    order = [F.col("score").desc(), F.col("feat")]
    window = Window.partitionBy("query_id")
    old = rows.withColumn("rank", F.row_number().over(window.orderBy(*order, F.col("_r"))))
    new = rows.withColumn("rank", F.row_number().over(window.orderBy(*order, F.col("_r").desc())))
    return A.tie_aware_replay(old, new, ["feat"]).groupBy("replay").agg(F.count(F.lit(1)).alias("n"))


@query("q09_ordered_equality", """
SELECT a.split, count(*) AS n_left, count(b.query_id) AS n_right, count(*) FILTER (WHERE a.class = b.class) AS class_equal, count(*) FILTER (WHERE a.cluster_key = b.cluster_key) AS cluster_key_equal
FROM plain_qs a LEFT JOIN (SELECT query_id, class, CASE WHEN query_id % 9 = 0 THEN cluster_key + 1 ELSE cluster_key END AS cluster_key FROM plain_qs WHERE query_id % 20 <> 11) b USING (query_id) GROUP BY a.split""")
def q09(t: Tables):
    """Row-by-row equality of two numbered tables per split."""
    q = V.plain_queries(t)
    other = q.filter(F.col("query_id") % 20 != 11).withColumn(
        "cluster_key", F.when(F.col("query_id") % 9 == 0, F.col("cluster_key") + 1).otherwise(F.col("cluster_key")))
    return A.ordered_equality(q, other, ["split", "query_id"], ["class", "cluster_key"])


@query("q10_matched_cohorts", """SELECT cohort, count(*) AS n, CAST(sum(query_id) AS BIGINT) AS id_sum FROM cohorts GROUP BY cohort""")
def q10(t: Tables):
    """Queries whose list is the same in two pools, and the others."""
    rows = A.matched_cohort(descriptors(t, ("alpha",)))
    return rows.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.sum("query_id").alias("id_sum"))


@query("q10_equal_prior_lists", """
SELECT count(*) AS n_lists, count(*) FILTER (WHERE a.p = b.p) AS equal_priors FROM (SELECT query_id, list(prior ORDER BY rank) AS p FROM top_historical GROUP BY query_id) a
JOIN (SELECT query_id, list(prior ORDER BY rank) AS p FROM thin WHERE rank <= 10 GROUP BY query_id) b USING (query_id)""")
def q10_priors(t: Tables):
    """Lists with exactly equal prior vectors."""
    a = V.lists(t, "historical").select("query_id", "rank", F.col("prior").alias("a"), F.col("n").alias("na"))
    b = thinned_pool(t).filter(F.col("rank") <= 10).select("query_id", "rank", F.col("prior").alias("b"))
    both = a.join(b, ["query_id", "rank"], "full_outer").groupBy("query_id").agg(
        F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    kept = both.filter((F.col("n_a") > 0) & (F.col("n_b") > 0))
    equal = (F.col("same") == F.col("n_a")) & (F.col("same") == F.col("n_b"))
    return kept.agg(F.count(F.lit(1)).alias("n_lists"), F.count_if(equal).alias("equal_priors"))


@query("q11_recorded_hits", """
SELECT count(*) AS n, count(*) FILTER (WHERE (list_sort(string_split(p_name, ' ')) = list_sort(string_split(reverse_name, ' '))) <> (p_partkey % 10 <> 0)) AS wrong FROM (
  SELECT p_partkey, p_name, string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] AS reverse_name FROM part)""")
def q11(t: Tables):
    """Stored match flags recomputed with order-free keys."""
    dotted = F.regexp_replace("p_name", " ", ".")
    words = F.split("p_name", " ")
    turned = F.concat(words[1], F.lit("."), words[0])
    rows = t.part.select((K.set_key(dotted) == K.set_key(turned)).alias("hit"), (F.col("p_partkey") % 10 != 0).alias("stored"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit") != F.col("stored")).alias("wrong"))


@query("q12_recomputed_effects", """SELECT pool, count(*) AS n, count(*) AS close FROM (SELECT pool, query_id FROM all_effects WHERE pool IN ('historical', 'beta') GROUP BY ALL) GROUP BY pool""")
def q12(t: Tables):
    """Effects recomputed from rank rows equal the stored ones to 1e-12."""
    names = ("historical", "beta")
    stored = V.effects(t, names).groupBy("pool", "query_id").agg(F.avg("d_mrr").alias("value"))
    rank = V.ranks(t, names).filter(F.col("prior_rank") > 0)
    sign = F.when(F.col("arm") == "augmented", 1.0).otherwise(-1.0)
    again = rank.groupBy("pool", "query_id").agg((F.sum(sign / F.col("rank")) / len(V.SEEDS)).alias("value"))
    return A.close_check(stored, again, ["pool", "query_id"], "value").groupBy("pool").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("close").alias("close"))


@query("q13_reachability", """
SELECT CASE WHEN x.part_key IS NOT NULL THEN 'reachable' WHEN p.p_partkey IS NOT NULL THEN 'present_not_reached' ELSE 'absent' END AS state, count(*) AS n
FROM (SELECT DISTINCT cand_key FROM raw_beta) k LEFT JOIN (SELECT p_partkey AS part_key FROM part WHERE p_size > 10) x ON x.part_key = k.cand_key LEFT JOIN part p ON p.p_partkey = k.cand_key GROUP BY 1""")
def q13(t: Tables):
    """Required keys found by lookup, present but not reached, or absent."""
    required = V.raw_lines(t, "beta").select("cand_key").distinct()
    reached = t.part.filter(F.col("p_size") > 10).select(F.col("p_partkey").alias("cand_key"), F.lit(1).alias("_r"))
    stored = t.part.select(F.col("p_partkey").alias("cand_key"), F.lit(1).alias("_s"))
    state = F.when(F.col("_r").isNotNull(), "reachable").when(F.col("_s").isNotNull(), "present_not_reached").otherwise("absent")
    return required.join(reached, "cand_key", "left").join(stored, "cand_key", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("q14_typed_exclusions", """
SELECT split, count(*) AS n_expected, count(*) FILTER (WHERE truth_key <> -1) AS mapped, count(*) FILTER (WHERE truth_key = -1) AS excluded, true AS is_partition FROM qs GROUP BY split""")
def q14(t: Tables):
    """Mapped and excluded rows make up the expected ones, by split."""
    q = V.queries(t)
    mapped = q.filter(F.col("truth_key") != -1).select("query_id", F.lit("mapped").alias("part"))
    excluded = q.filter(F.col("truth_key") == -1).select("query_id", F.lit("excluded").alias("part"))
    held = mapped.unionByName(excluded)
    joined = V.plain_queries(t).select("query_id", "split").join(held, "query_id", "full_outer")
    return joined.groupBy("split").agg(
        F.count_distinct("query_id").alias("n_expected"), F.count_if(F.col("part") == "mapped").alias("mapped"),
        F.count_if(F.col("part") == "excluded").alias("excluded"),
        ((F.count(F.lit(1)) == F.count_distinct("query_id")) & (F.count_if(F.col("part").isNull()) == 0)).alias("is_partition"))


@query("q15_adapter_audit", """
SELECT count(*) AS n_rows, count(DISTINCT p.query_id) AS n_queries, count(*) - count(DISTINCT p.query_id) AS extra_rows, CAST(max(n.c) + 1 AS INTEGER) AS longest
FROM multi_labelled p JOIN (SELECT query_id, count(*) AS c FROM multi_labelled WHERE NOT is_match GROUP BY query_id) n ON n.query_id = p.query_id WHERE p.is_match""")
def q15(t: Tables):
    """Rows, queries and longest list of expanded positives."""
    return X.adapter_audit(X.expand_positives(multi_labelled(t)))


@query("q16_replicate_inputs", """
SELECT CAST(cluster_key AS VARCHAR) AS name, count(*) AS n_replicates, count(DISTINCT {'a': cluster_key % 3, 'b': class}) = 1 AS consistent FROM plain_qs GROUP BY 1""")
def q16(t: Tables):
    """Values that must agree over all replicates of a name."""
    rows = V.plain_queries(t).select(
        F.col("cluster_key").cast("string").alias("name"), (F.col("cluster_key") % 3).alias("a"), F.col("class").alias("b"))
    return A.consistent_inputs(rows, "name", ["a", "b"])
