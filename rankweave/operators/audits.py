"""Integrity checks between tables, expressed as joins and aggregates.

Each returns its findings as a DataFrame; an empty result or a true flag means success.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.scores import float32_steps, relative_difference, within_tolerance
from rankweave.operators import pools as P
from rankweave.operators.idsets import bitmap_bytes, tagged_bitmaps
from rankweave.scale import following, ranked, with_row

QUERY, CAND = P.QUERY, P.CAND


def lookup(required: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Left join that marks each required key as hit, failed (null value) or missing."""
    found = table.select(key, value, F.lit(True).alias("_present"))
    state = (F.when(F.col("_present").isNull(), "missing").when(F.col(value).isNull(), "failed")
             .otherwise("hit"))
    return required.join(found, key, "left").withColumn("state", state).drop("_present")


def lookup_counts(looked: DataFrame, by: Sequence[str]) -> DataFrame:
    return looked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("state") == "hit").alias("hits"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") == "missing").alias("missing"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def validated_join(left: DataFrame, right: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """Inner join of two unique-key tables with suffixes, flagging rows that disagree."""
    a = left.select(key, *[F.col(c).alias(f"{c}_left") for c in left.columns if c != key])
    b = right.select(key, *[F.col(c).alias(f"{c}_right") for c in right.columns if c != key])
    agrees: Column = F.lit(True)
    for column in same:
        agrees = agrees & F.col(f"{column}_left").eqNullSafe(F.col(f"{column}_right"))
    return a.join(b, key).withColumn("agrees", agrees)


def pairing_report(reference: DataFrame, observed: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per column: rows that differ (absent rows included) and the first differing key."""
    a = reference.select(key, *[F.col(c).alias(f"{c}_a") for c in columns], F.lit(1).alias("_a"))
    b = observed.select(key, *[F.col(c).alias(f"{c}_b") for c in columns], F.lit(1).alias("_b"))
    both = a.join(b, key, "full_outer")
    absent = F.col("_a").isNull() | F.col("_b").isNull()
    cells = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), (absent | ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))).alias("differs"))
        for c in columns]))
    return (
        both.select(key, cells.alias("c")).groupBy(F.col("c.column").alias("column"))
        .agg(F.count_if("c.differs").alias("n_differ"),
             F.min(F.when(F.col("c.differs"), F.col(key))).alias("first_key"))
    )


def reconcile_status(rows: DataFrame, stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Recounted status per group against stored counts."""
    counts = rows.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("counted"))
    joined = counts.join(stored, [*by, "status"], "full_outer")
    return joined.select(
        *by, "status", F.coalesce("counted", F.lit(0)).alias("counted"),
        F.coalesce("stored", F.lit(0)).alias("stored"),
        (F.coalesce("counted", F.lit(0)) == F.coalesce("stored", F.lit(0))).alias("matches"))


def close_check(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """Named equalities between two result tables; rows present on one side only fail."""
    a = left.select(*keys, F.col(value).alias("_a"))
    b = right.select(*keys, F.col(value).alias("_b"))
    ok = F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= tolerance, F.lit(False))
    both_null = F.col("_a").isNull() & F.col("_b").isNull()
    return a.join(b, list(keys), "full_outer").select(*keys, (ok | both_null).alias("close"))


def tie_aware_replay(old: DataFrame, new: DataFrame, features: Sequence[str], span: float = 1e-6) -> DataFrame:
    """Check changed ranks of a replay.

    A changed rank is allowed only within a block of candidates of the query that have
    identical features, contiguous ranks and nearly equal scores.
    """
    blocks = new.groupBy(QUERY, *features).agg(
        F.count(F.lit(1)).alias("_n"), F.min("rank").alias("_lo"), F.max("rank").alias("_hi"),
        (F.max("score") - F.min("score")).alias("_span"))
    allowed = (F.col("_hi") - F.col("_lo") + 1 == F.col("_n")) & (F.col("_span") <= span)
    compared = (
        new.join(blocks, [QUERY, *features])
        .join(old.select(QUERY, CAND, F.col("rank").alias("old_rank")), [QUERY, CAND])
    )
    inside = F.col("old_rank").between(F.col("_lo"), F.col("_hi"))
    return compared.select(
        QUERY, CAND, "rank", "old_rank",
        F.when(F.col("rank") == F.col("old_rank"), "same")
        .when(allowed & inside, "tie").otherwise("changed").alias("replay"))


def ordered_equality(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Row-by-row equality of two numbered tables, per group of the first key."""
    a = left.select(*keys, *[F.col(c).alias(f"{c}_a") for c in columns], F.lit(1).alias("_a"))
    b = right.select(*keys, *[F.col(c).alias(f"{c}_b") for c in columns], F.lit(1).alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    return both.groupBy(keys[0]).agg(
        F.count("_a").alias("n_left"), F.count("_b").alias("n_right"),
        *[F.count_if(F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) & F.col("_a").isNotNull()
                     & F.col("_b").isNotNull()).alias(f"{c}_equal") for c in columns])


def partition_proof(expected: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """One row: sizes of the parts, overlap (ids of more than one part), and whether they exactly make up ``expected``.

    All sets are bitmaps of whole-number ids, built in one aggregation and combined bucket by bucket.
    """
    sets = tagged_bitmaps({"e": expected, **{f"p_{name}": ids for name, ids in parts.items()}}, key)
    named = F.col("name")
    bits = sets.groupBy("bucket").agg(
        F.bitmap_or_agg(F.when(named == "e", F.col("bits"))).alias("_e"), F.bitmap_or_agg(F.when(named != "e", F.col("bits"))).alias("_any"),
        F.bitmap_or_agg("bits").alias("_all"), *[F.bitmap_or_agg(F.when(named == f"p_{n}", F.col("bits"))).alias(f"_in_{n}") for n in parts])
    size = lambda c: F.coalesce(F.sum(F.bitmap_count(c)), F.lit(0))
    # Ids in more than one part, pair by pair of consecutive unions: each part against all before it.
    overlaps = sets.filter(named != "e")
    repeated = overlaps.select("bucket", F.posexplode(bitmap_bytes(F.col("bits"))).alias("_byte", "_flags")).filter("_flags <> 0")
    twice = repeated.groupBy("bucket", "_byte").agg(F.collect_list("_flags").alias("f")).filter(F.size("f") > 1)
    more = F.aggregate("f", F.struct(F.lit(0).alias("seen"), F.lit(0).alias("more")), lambda s, x: F.struct(
        s["seen"].bitwiseOR(x).alias("seen"), s["more"].bitwiseOR(s["seen"].bitwiseAND(x)).alias("more")))["more"]
    overlap = twice.agg(F.coalesce(F.sum(F.bit_count(more)), F.lit(0)).cast("long").alias("n_overlap"))
    counts = bits.agg(
        size("_e").alias("n_expected"), *[size(f"_in_{n}").alias(f"n_{n}") for n in parts],
        (size("_all") - size("_any")).alias("n_missing"), (size("_all") - size("_e")).alias("n_extra"))
    whole = with_row(counts, overlap)
    return whole.select("n_expected", *[f"n_{n}" for n in parts], "n_overlap", "n_missing", "n_extra",
                        ((F.col("n_overlap") == 0) & (F.col("n_missing") == 0) & (F.col("n_extra") == 0)).alias("is_partition"))


def text_digest(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Content digest of a table that does not depend on row order.

    Include a rank column to make it order-aware.  A row is written as its fields with their lengths in front
    (a null is a mark of its own), so that no two rows read alike; the digest is the count and the sums of the
    four words of the rows' 128-bit hashes.
    """
    def field(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.when(text.isNull(), F.lit("n;")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text, F.lit(";")))

    word = F.md5(F.concat(*[field(c) for c in columns]))
    parts = [F.sum(F.conv(F.substring(word, 8 * i + 1, 8), 16, 10).cast("long")).alias(f"digest_{i}") for i in range(4)]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *parts)


def consistent_inputs(records: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """Names whose values must agree over all replicates, with a verdict."""
    return records.groupBy(name).agg(
        F.count(F.lit(1)).alias("n_replicates"),
        (F.count_distinct(F.struct(*values)) == 1).alias("consistent"))


def matched_cohort(descriptors: DataFrame) -> DataFrame:
    """'matched' where both lists have the same members in the same order, else 'changed'."""
    same = (
        (F.col("length") == F.col("reference_length")) & (F.col("shared") == F.col("length"))
        & (F.col("jaccard") == 1) & ((F.col("kendall") == 1) | (F.col("length") == 1))
    )
    return descriptors.withColumn("cohort", F.when(F.coalesce(same, F.lit(False)), "matched").otherwise("changed"))


def aligned_priors(reference: DataFrame, other: DataFrame) -> DataFrame:
    """Candidates of both pools with their prior differences."""
    a = reference.select(QUERY, CAND, "rank", F.col("prior").alias("reference_prior"))
    b = other.select(QUERY, CAND, F.col("prior").alias("other_prior"))
    old, new = F.col("reference_prior"), F.col("other_prior")
    return a.join(b, [QUERY, CAND]).withColumns({
        "absolute": F.abs(new - old), "relative": relative_difference(old, new),
        "exact": old == new, "close": within_tolerance(old, new)})


def alignment_summary(aligned: DataFrame) -> DataFrame:
    return aligned.agg(
        F.count(F.lit(1)).alias("aligned"), F.count_if("exact").alias("exact"),
        F.max("absolute").alias("max_absolute"), F.max("relative").alias("max_relative"),
        F.count_if(~F.col("close")).alias("beyond_tolerance"))


def step_summary(aligned: DataFrame) -> DataFrame:
    """Largest single-precision distance over aligned priors."""
    steps = aligned.select(float32_steps("reference_prior", "other_prior").alias("steps"))
    return steps.agg(F.max("steps").alias("max_steps"), F.count_if(F.col("steps").isNull()).alias("undefined"))


def product_order(reference: DataFrame, other: DataFrame) -> DataFrame:
    """Queries of both pools whose first-seen position differs."""
    def places(pool: DataFrame, name: str) -> DataFrame:
        first = pool.groupBy(QUERY).agg(F.min("first_seen").alias("_first"))
        return ranked(first, [], [F.col("_first"), F.col(QUERY)], name).drop("_first")

    return places(reference, "reference_place").join(places(other, "other_place"), QUERY).filter(
        F.col("reference_place") != F.col("other_place"))


def pool_issues(reference: DataFrame, other: DataFrame) -> DataFrame:
    """Every difference between two ordered pools as rows (query_id, issue, cand_key)."""
    products = reference.select(QUERY, F.lit(1).alias("_a")).distinct().join(
        other.select(QUERY, F.lit(1).alias("_b")).distinct(), QUERY, "full_outer")
    none = F.lit(None).cast(reference.schema[CAND].dataType).alias(CAND)
    one_sided = products.filter(F.col("_a").isNull() | F.col("_b").isNull()).select(
        QUERY, F.when(F.col("_b").isNull(), "missing_product").otherwise("extra_product").alias("issue"), none)
    order = product_order(reference, other).select(QUERY, F.lit("product_order_mismatch").alias("issue"), none)
    lists = P.list_agreement(reference, other).filter(F.col("agreement") != "same_order").select(
        QUERY, F.lit("candidate_identity_or_order_mismatch").alias("issue"), none)
    aligned = aligned_priors(reference, other)
    beyond = aligned.filter(~F.col("close")).select(
        QUERY, F.lit("prior_tolerance_exceeded").alias("issue"), CAND)
    placed = ranked(aligned.select(QUERY, CAND, F.col("rank").alias("_ref"), "other_prior"), [QUERY],
                    [F.col("_ref")], "rank")
    inverted = P.adjacent_inversions(placed, "other_prior").select(
        QUERY, F.lit("prior_order_inversion").alias("issue"), CAND)
    return (one_sided.unionByName(order).unionByName(lists).unionByName(beyond).unionByName(inverted))


def comparison_summary(
    issues: DataFrame, audits: tuple[DataFrame, DataFrame], rejects: tuple[DataFrame, DataFrame],
) -> DataFrame:
    """The checks of a pool comparison as one row."""
    def none_of(*kinds: str) -> Column:
        return F.count_if(F.col("issue").isin(*kinds)) == 0

    found = issues.agg(
        none_of("missing_product", "extra_product").alias("product_identity_exact"),
        none_of("product_order_mismatch", "missing_product", "extra_product").alias("product_order_exact"),
        none_of("candidate_identity_or_order_mismatch", "missing_product").alias("identity_order_exact"),
        none_of("prior_tolerance_exceeded").alias("prior_tolerance_passed"),
        F.count_if(F.col("issue") == "prior_order_inversion").alias("prior_inversion_count"),
        F.count_distinct(QUERY).alias("discrepancy_product_count"))
    left, right = audits
    counters = left.columns
    pair = with_row(left, right.select(*[F.col(c).alias(f"{c}_b") for c in counters]))
    same: Column = F.lit(True)
    for column in counters:
        same = same & (F.col(column) == F.col(f"{column}_b"))
    fatal_columns = ("malformed_json_lines", "missing_required_fields", "invalid_prior_records",
                     "nonfinite_prior_records")
    fatal_a = sum((F.col(c) for c in fatal_columns), F.lit(0))
    fatal_b = sum((F.col(f"{c}_b") for c in fatal_columns), F.lit(0))
    counts = pair.select(same.alias("audit_counts_exact"), (fatal_a == 0).alias("reference_loads"),
                         (fatal_b == 0).alias("other_loads"))
    kept = [c for c in rejects[0].columns if c != "line_no"]
    a = ranked(rejects[0], [], [F.col("line_no")], "place").select("place", *kept)
    b = ranked(rejects[1], [], [F.col("line_no")], "place").select("place", *kept)
    differ = a.exceptAll(b).unionByName(b.exceptAll(a)).agg(
        (F.count(F.lit(1)) == 0).alias("rejected_records_exact"))
    row = with_row(with_row(found, counts), differ)
    passed = (
        F.col("product_identity_exact") & F.col("product_order_exact") & F.col("identity_order_exact")
        & F.col("prior_tolerance_passed") & (F.col("prior_inversion_count") == 0)
        & F.col("audit_counts_exact") & F.col("reference_loads") & F.col("other_loads")
        & F.col("rejected_records_exact")
    )
    return row.withColumn("comparison_passed", passed)


def contiguity(rows: DataFrame) -> DataFrame:
    """Per query: stored ranks must be 1..n without gap or repeat."""
    return rows.groupBy(QUERY).agg(
        F.count(F.lit(1)).alias("n"),
        ((F.min("rank") == 1) & (F.max("rank") == F.count(F.lit(1)))
         & (F.count_distinct("rank") == F.count(F.lit(1)))).alias("contiguous"))


def split_runs(lines: DataFrame) -> DataFrame:
    """Number of runs of each key in line order; more than one means a split run."""
    placed = ranked(lines.select(QUERY, "line_no"), [], [F.col("line_no")], "place")
    pairs = following(placed, [], "place", {"next_key": QUERY})
    ends = F.col("next_key").isNull() | (F.col("next_key") != F.col(QUERY))
    return pairs.groupBy(QUERY).agg(F.count_if(ends).alias("runs"))
