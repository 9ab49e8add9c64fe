"""The candidate-ranking tables, derived from the given parquet tables.

An order is a query, its customer the cluster, its line items the candidate lines of
several pools; the recorded answer is the part with the largest discount.  Each view is
stated twice: as DataFrame code and as the SQL used by the oracle statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.scores import normalised_rank
from rankweave.operators import pools as P
from rankweave.operators.metrics import truth_ranks
from rankweave.plans.registry import Tables, cte
from rankweave.rng import SPAN, random_sql, with_randoms
from rankweave.scale import hot_limit
from rankweave.session import materialise_by

SEEDS = (42, 43, 44, 45, 46)
ARMS = ("baseline", "augmented")
POOLS = ("historical", "alpha", "beta", "merged")
CAP = 10
NOISE = 0.3
FEATURE_WEIGHT = 2.0


def split_column(key: Column) -> Column:
    digit = key % 10
    return F.when(digit < 8, "train").when(digit == 8, "valid").otherwise("test")


def queries(t: Tables) -> DataFrame:
    """query_id, cluster_key, class, split, truth_key (-1 where there is no answer)."""
    if "queries" in t.shared:
        return t.shared["queries"]
    best = _lines(t).groupBy(F.col("l_orderkey").alias("query_id")).agg(
        F.max(F.struct(F.col("l_discount"), (-F.col("l_partkey")).alias("neg"))).alias("b"))
    truth = best.select("query_id", (-F.col("b.neg")).alias("found"))
    return (
        plain_queries(t).join(truth, "query_id", "left")
        .withColumn("truth_key", F.when(F.col("query_id") % 7 == 0, F.lit(-1))
                    .otherwise(F.coalesce("found", F.lit(-1))))
        .drop("found")
    )


def plain_queries(t: Tables) -> DataFrame:
    """Queries without the recorded answer."""
    key = F.col("o_orderkey")
    return t.shared.get("orders", t.orders).select(key.alias("query_id"), F.col("o_custkey").alias("cluster_key"),
                           F.col("o_orderpriority").alias("class"), split_column(key).alias("split"))


def _lines(t: Tables) -> DataFrame:
    return t.shared.get("lines", t.lineitem)


def raw_lines(t: Tables, pool: str) -> DataFrame:
    """query_id, cand_key, prior, line_no, feat for one source pool."""
    cand = F.col("l_partkey")
    if pool == "beta":
        cand = F.when(F.col("l_returnflag") == "R", cand + 1000000).otherwise(cand)
    prior = {"historical": F.col("l_extendedprice"),
             "alpha": F.col("l_extendedprice") * (1 - F.col("l_discount")),
             "beta": F.col("l_quantity")}[pool]
    line = F.col("l_linenumber").cast("long") * 10000000000 + F.col("l_suppkey")
    return _lines(t).select(F.col("l_orderkey").alias("query_id"), cand.alias("cand_key"),
                             prior.alias("prior"), line.alias("line_no"),
                             F.col("l_discount").alias("feat"))


def pool(t: Tables, name: str) -> DataFrame:
    """Deduplicated pool, not yet ordered."""
    if f"pool_{name}" in t.shared:
        return t.shared[f"pool_{name}"]
    if name == "merged":
        return P.merge_sources(*[P.full_list(pool(t, n), checked=short(t)) for n in ("alpha", "beta")], ["feat"])
    return P.dedupe(raw_lines(t, name), extras=["feat"])


def share(t: Tables, again: tuple[str, ...] | None = None) -> None:
    """Lay orders and line items together by order, once, for queries that build several pools several times.

    Deduplication, lists, answers and joins on the query then need no exchange.  Where one order is huge the
    tables stay spread instead.  With ``again`` the queries with their answers, and the pools it names, are
    worked out once for several uses.
    """
    if not t.shared:
        lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                  "l_discount", "l_returnflag")
        orders = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
        if hot_limit(lines, ["l_orderkey"]) is None:
            t.shared.update(lines=materialise_by(lines, "l_orderkey", gather=True), orders=materialise_by(orders, "o_orderkey", gather=True))
    if t.shared and again is not None and "queries" not in t.shared:
        t.shared.update({"queries": materialise_by(queries(t), "query_id"),
                         **{f"pool_{name}": materialise_by(pool(t, name), "query_id") for name in again}})


def again(names: tuple[str, ...]) -> tuple[str, ...]:
    """Pools among ``names`` that the merged one uses too."""
    return ("alpha", "beta") if "merged" in names else ()


def short(t: Tables) -> bool:
    """Whether all lists are known to be short: ``share`` lays tables together only after that check."""
    return bool(t.shared)


def ordered(t: Tables, name: str) -> DataFrame:
    """Whole lists in order."""
    return P.full_list(pool(t, name), checked=short(t)).select(
        "query_id", "cand_key", "prior", "feat", "first_seen", "rank", "n")


def lists(t: Tables, name: str, cap: int = CAP) -> DataFrame:
    """Lists cut at ``cap``."""
    return P.top_list(pool(t, name), cap).select(
        "query_id", "cand_key", "prior", "feat", "rank", "n")


def all_lists(t: Tables, names: tuple[str, ...] = POOLS) -> DataFrame:
    out = None
    if len(names) > 2:
        share(t)
    for name in names:
        part = lists(t, name).withColumn("pool", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def kept_lists(t: Tables, name: str) -> DataFrame:
    """Capped lists for several uses: written once, together by query, where ``share`` laid the tables together."""
    if not short(t):
        return lists(t, name)
    if f"lists_{name}" not in t.shared:
        t.shared[f"lists_{name}"] = materialise_by(lists(t, name), "query_id")
    return t.shared[f"lists_{name}"]


def scored_lists(t: Tables, name: str, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """Lists with one score column per arm and seed, e.g. ``baseline_42``."""
    df = lists(t, name).withColumn("norm", normalised_rank(F.col("rank"), F.col("n")))
    df = with_randoms(df, {f"u_{s}": s for s in seeds}, "query_id", "cand_key")
    kept = [c for c in df.columns if not c.startswith("u_")]
    base = {s: F.col("norm") + F.lit(NOISE) * (F.col(f"u_{s}") / F.lit(SPAN)) for s in seeds}
    return df.select(
        *kept, *[base[s].alias(f"baseline_{s}") for s in seeds],
        *[(base[s] + F.lit(FEATURE_WEIGHT) * F.col("feat")).alias(f"augmented_{s}") for s in seeds])


def wide_ranks(t: Tables, name: str, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """One row per query: prior_rank, list_len and a rank column per arm and seed."""
    base = queries(t)
    marked = (
        scored_lists(t, name, seeds)
        .join(base.select("query_id", F.col("truth_key").alias("_truth")), "query_id")
        .withColumn("is_truth", F.col("cand_key") == F.col("_truth"))
    )
    names = [f"{arm}_{seed}" for arm in ARMS for seed in seeds]
    placed = truth_ranks(marked, names)
    return base.join(placed, "query_id").withColumn("pool", F.lit(name))


def ranks(t: Tables, names: tuple[str, ...] = ("historical",), seeds=SEEDS) -> DataFrame:
    """Long rank rows: pool, arm, seed, query and the rank of the answer (0 = not covered)."""
    out = None
    if len(names) > 2:
        share(t, again(names))
    for name in names:
        wide = wide_ranks(t, name, seeds)
        cells = F.explode(F.array(*[
            F.struct(F.lit(arm).alias("arm"), F.lit(seed).alias("seed"),
                     F.col(f"{arm}_{seed}").alias("rank")) for arm in ARMS for seed in seeds]))
        part = wide.select("pool", "query_id", "cluster_key", "class", "split", "list_len",
                           "prior_rank", cells.alias("c")).select("*", "c.*").drop("c")
        out = part if out is None else out.unionByName(part)
    return out


def effects(t: Tables, names: tuple[str, ...] = ("historical",), seeds=SEEDS) -> DataFrame:
    """Per covered query and seed: augmented minus baseline top-1 and reciprocal rank."""
    out = None
    if len(names) > 2:
        share(t, again(names))
    for name in names:
        wide = wide_ranks(t, name, seeds).filter(F.col("prior_rank") > 0)
        cells = []
        for seed in seeds:
            a, b = F.col(f"augmented_{seed}"), F.col(f"baseline_{seed}")
            top = F.when(a == 1, 1.0).otherwise(0.0) - F.when(b == 1, 1.0).otherwise(0.0)
            cells.append(F.struct(F.lit(seed).alias("seed"), top.alias("d_top1"),
                                  (F.lit(1.0) / a - F.lit(1.0) / b).alias("d_mrr"),
                                  b.alias("base_rank"), a.alias("aug_rank")))
        part = wide.select("pool", "query_id", "cluster_key", "class", "split", "list_len",
                           "prior_rank", F.explode(F.array(*cells)).alias("c")).select("*", "c.*")
        part = part.drop("c")
        out = part if out is None else out.unionByName(part)
    return out


cte("truth", """
SELECT l_orderkey AS query_id, l_partkey AS found FROM (
  SELECT l_orderkey, l_partkey, row_number() OVER (
    PARTITION BY l_orderkey ORDER BY l_discount DESC, l_partkey) AS rn FROM lineitem) WHERE rn = 1""")
cte("plain_qs", """
SELECT o_orderkey AS query_id, o_custkey AS cluster_key, o_orderpriority AS class,
  CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'valid' ELSE 'test' END AS split
FROM orders""")
cte("qs", """
SELECT p.*, CASE WHEN p.query_id % 7 = 0 THEN -1 ELSE coalesce(found, -1) END AS truth_key
FROM plain_qs p LEFT JOIN truth USING (query_id)""")
_LINES = """
SELECT l_orderkey AS query_id, {cand} AS cand_key, {prior} AS prior,
  CAST(l_linenumber AS BIGINT) * 10000000000 + l_suppkey AS line_no, l_discount AS feat FROM lineitem"""
cte("raw_historical", _LINES.format(cand="l_partkey", prior="l_extendedprice"))
cte("raw_alpha", _LINES.format(cand="l_partkey", prior="l_extendedprice * (1 - l_discount)"))
cte("raw_beta", _LINES.format(
    cand="CASE WHEN l_returnflag = 'R' THEN l_partkey + 1000000 ELSE l_partkey END",
    prior="l_quantity"))
for _name in ("historical", "alpha", "beta"):
    cte(f"dedup_{_name}", f"""
SELECT query_id, cand_key, prior, feat, first_seen, copies, line_no AS winner_line FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, cand_key ORDER BY prior DESC, line_no, feat DESC) AS rn,
    min(line_no) OVER (PARTITION BY query_id, cand_key) AS first_seen,
    count(*) OVER (PARTITION BY query_id, cand_key) AS copies FROM raw_{_name}) WHERE rn = 1""")
    cte(f"pool_{_name}", f"""
SELECT query_id, cand_key, prior, feat, first_seen,
  row_number() OVER (PARTITION BY query_id ORDER BY prior DESC, first_seen, cand_key) AS rank,
  count(*) OVER (PARTITION BY query_id) AS n FROM dedup_{_name}""")
cte("merge_rows", """
SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.cand_key, b.cand_key) AS cand_key,
  greatest(1.0::DOUBLE - (a.rank - 1) / greatest(a.n - 1, 1), 1.0::DOUBLE - (b.rank - 1) / greatest(b.n - 1, 1)) AS prior,
  CASE WHEN a.rank IS NULL THEN 0 ELSE 1 END AS source_a, CASE WHEN b.rank IS NULL THEN 0 ELSE 1 END AS source_b,
  a.rank AS rank_a, b.rank AS rank_b, a.prior AS prior_a, b.prior AS prior_b,
  coalesce(a.feat, b.feat) AS feat, 0::BIGINT AS first_seen
FROM pool_alpha a FULL OUTER JOIN pool_beta b ON a.query_id = b.query_id AND a.cand_key = b.cand_key""")
cte("pool_merged", """
SELECT query_id, cand_key, prior, feat, first_seen,
  row_number() OVER (PARTITION BY query_id ORDER BY prior DESC, cand_key) AS rank,
  count(*) OVER (PARTITION BY query_id) AS n FROM merge_rows""")
for _name in POOLS:
    cte(f"top_{_name}", f"""
SELECT '{_name}' AS pool, query_id, cand_key, prior, feat, rank, least(n, {CAP}) AS n
FROM pool_{_name} WHERE rank <= {CAP}""")
    _scores = ", ".join(random_sql(f"u_{s}", s, "query_id", "cand_key") for s in SEEDS)
    cte(f"scored_{_name}", f"""
SELECT *, 1.0::DOUBLE - (rank - 1) / greatest(n - 1, 1) AS norm, {_scores}, """ + ", ".join(
        f"norm + {NOISE}::DOUBLE * (u_{s} / {SPAN}::DOUBLE) AS baseline_{s}, "
        f"baseline_{s} + {FEATURE_WEIGHT}::DOUBLE * feat AS augmented_{s}" for s in SEEDS)
        + f" FROM top_{_name}")
    _cols = [f"{a}_{s}" for a in ARMS for s in SEEDS]
    cte(f"wide_{_name}", f"""
SELECT '{_name}' AS pool, q.*, l.list_len, l.prior_rank, """ + ", ".join(f"l.{c}" for c in _cols)
        + """ FROM qs q JOIN (SELECT query_id, max(n) AS list_len,
   coalesce(max(CASE WHEN tr THEN rank END), 0) AS prior_rank, """ + ", ".join(
        f"CASE WHEN max(t_{c}) IS NULL THEN 0 ELSE count(*) FILTER (WHERE {c} > t_{c} OR ({c} = t_{c} AND rank <= t_rank)) END AS {c}"
        for c in _cols) + f"""
  FROM (SELECT s.*, s.cand_key = q.truth_key AS tr,
     max(CASE WHEN tr THEN s.rank END) OVER w AS t_rank, """ + ", ".join(
        f"max(CASE WHEN tr THEN {c} END) OVER w AS t_{c}" for c in _cols) + f"""
     FROM scored_{_name} s JOIN qs q USING (query_id) WINDOW w AS (PARTITION BY query_id))
  GROUP BY query_id) l ON q.query_id = l.query_id""")
    cte(f"ranks_{_name}", " UNION ALL ".join(
        f"""SELECT pool, query_id, cluster_key, class, split, list_len, prior_rank, '{a}' AS arm,
  {s} AS seed, {a}_{s} AS rank FROM wide_{_name}""" for a in ARMS for s in SEEDS))
    cte(f"effects_{_name}", " UNION ALL ".join(
        f"""SELECT pool, query_id, cluster_key, class, split, list_len, prior_rank, {s} AS seed,
  (CASE WHEN augmented_{s} = 1 THEN 1.0::DOUBLE ELSE 0 END) - (CASE WHEN baseline_{s} = 1 THEN 1.0::DOUBLE ELSE 0 END) AS d_top1,
  1.0::DOUBLE / augmented_{s} - 1.0::DOUBLE / baseline_{s} AS d_mrr,
  baseline_{s} AS base_rank, augmented_{s} AS aug_rank FROM wide_{_name} WHERE prior_rank > 0"""
        for s in SEEDS))
cte("all_tops", " UNION ALL ".join(f"SELECT * FROM top_{n}" for n in POOLS))
cte("all_ranks", " UNION ALL ".join(f"SELECT * FROM ranks_{n}" for n in POOLS))
cte("all_effects", " UNION ALL ".join(f"SELECT * FROM effects_{n}" for n in POOLS))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that summation order does not show."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c)
                       for c, kind in df.dtypes])
