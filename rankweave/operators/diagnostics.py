"""Distribution summaries, correlations, strata and list descriptors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.operators.features import pair_count, pair_fold
from rankweave.scale import midranked, quantiles, ranked, running, settled, with_row

QUERY, CAND = "query_id", "cand_key"
QUARTILES = (0.25, 0.5, 0.75)


def distribution(rows: DataFrame, by: Sequence[str], value: str, sample: bool = False,
                 probabilities: Sequence[float] = QUARTILES) -> DataFrame:
    """n, mean, deviation, extremes and exact quantiles per group; null-safe."""
    by = list(by)
    deviation = F.stddev_samp(value) if sample else F.stddev_pop(value)
    moments = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), deviation.alias("sd"),
                                    F.min(value).alias("min"), F.max(value).alias("max"))
    points = quantiles(rows, by, value, probabilities, "_q").select(
        *by, *[F.col("_q")[i].alias(f"q{round(p * 1000):03d}") for i, p in enumerate(probabilities)])
    return moments.join(points, by, "left") if by else with_row(moments, points)


def correlation(rows: DataFrame, by: Sequence[str], x: str, y: str, spearman: bool = False, least: int = 3) -> DataFrame:
    """Pearson or average-rank Spearman; null below ``least`` pairs or if a side is constant."""
    by = list(by)
    pairs = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    if spearman:
        pairs = midranked(pairs, by, F.col("_x"), "_rx")
        pairs = midranked(pairs, by, F.col("_y"), "_ry").select(
            *by, F.col("_rx").alias("_x"), F.col("_ry").alias("_y"))
    varied = (F.min("_x") != F.max("_x")) & (F.min("_y") != F.max("_y")) & (F.count(F.lit(1)) >= least)
    ratio = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(varied, ratio).alias("correlation"))


def quartile_effects(rows: DataFrame, by: Sequence[str], feature: str, effect: str) -> DataFrame:
    """Mean effect by average-rank quartile of a feature; none below 4 rows or if constant.

    Ties stay together, which a plain ntile would split.
    """
    by = list(by)
    placed = midranked(rows.filter(F.col(feature).isNotNull()), by, F.col(feature), "_rank", "_n")
    quarter = F.least(F.greatest(F.ceil(4 * F.col("_rank") / F.col("_n")), F.lit(1)), F.lit(4))
    out = placed.groupBy(*by, quarter.alias("quartile")).agg(
        F.max("_n").alias("_n"), F.count(F.lit(1)).alias("n"), F.min(feature).alias("feature_min"),
        F.max(feature).alias("feature_max"), F.avg(effect).alias("mean_effect"))
    spread = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    # At most four rows per group here.
    varied = F.min("feature_min").over(spread) != F.max("feature_max").over(spread)
    return out.withColumn("_v", varied).filter((F.col("_n") >= 4) & F.col("_v")).drop("_v", "_n")


def list_moments(lists: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per list: size, corrected skewness, top-1 minus top-2 gap, whether values tie."""
    v = F.col(value)
    n = F.count(F.lit(1))
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    varied = (n > 2) & (F.min(value) != F.max(value))
    first = F.max(F.when(F.col("rank") == 1, v))
    second = F.max(F.when(F.col("rank") == 2, v))
    return lists.groupBy(*by).agg(
        n.alias("n"), F.when(varied, F.skewness(value) * factor).alias("skew"),
        (first - second).alias("gap"), (F.count_distinct(value) < n).alias("tied"))


def prior_summary(lists: DataFrame, by: Sequence[str] = (), value: str = "prior") -> DataFrame:
    """Mean within-list skewness, median top gap and share of lists with tied priors."""
    per = list_moments(lists, [*by, QUERY], value)
    gaps = quantiles(per, by, "gap", [0.5], "_q")
    out = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_lists"), F.avg("skew").alias("mean_skew"), F.count("skew").alias("skew_defined"),
        F.count("gap").alias("gap_defined"), F.avg(F.when(F.col("tied"), 1.0).otherwise(0.0)).alias("tie_fraction"))
    gaps = gaps.select(*by, F.col("_q")[0].alias("median_gap"))
    return out.join(gaps, list(by), "left") if by else with_row(out, gaps)


def gap_groups(lists: DataFrame, value: str = "prior") -> DataFrame:
    """Group of each list by its top gap: -1 for one item, else 0..3 by quartile cuts.

    A gap equal to a cut belongs to the lower group.
    """
    gaps = lists.filter(F.col("rank") <= 2).groupBy(QUERY).agg(
        (F.max(F.when(F.col("rank") == 1, F.col(value))) - F.max(F.when(F.col("rank") == 2, F.col(value)))).alias("gap"))
    # The cuts and the groups read the same gaps.
    gaps, _ = settled(gaps)
    cuts = quantiles(gaps, [], "gap", QUARTILES, "_cuts")
    joined = with_row(gaps, cuts)
    group = F.when(F.col("gap").isNull(), -1)
    for i in range(3):
        group = group.when(F.col("gap") <= F.col("_cuts")[i], i)
    return joined.select(QUERY, "gap", group.otherwise(3).alias("gap_group"))


def benjamini_hochberg(tests: DataFrame, family: Sequence[str], order: Sequence[str], p: str = "p_value") -> DataFrame:
    """Step-up adjusted p-values within each family."""
    keys = [F.col(c) for c in order]
    placed = ranked(tests, family, [F.col(p), *keys], "_i", "_m")
    scaled = placed.withColumn("_scaled", F.col(p) * F.col("_m") / F.col("_i"))
    out = running(scaled, family, [-F.col("_i")], {"_low": ("min", F.col("_scaled"))})
    return out.withColumn("p_bh", F.least(F.col("_low"), F.lit(1.0))).drop("_i", "_m", "_scaled", "_low")


def holm(tests: DataFrame, family: Sequence[str], order: Sequence[str], p: str = "p_value") -> DataFrame:
    """Step-down adjusted p-values within each family."""
    keys = [F.col(c) for c in order]
    placed = ranked(tests, family, [F.col(p), *keys], "_i", "_m")
    scaled = placed.withColumn("_scaled", F.col(p) * (F.col("_m") - F.col("_i") + 1))
    out = running(scaled, family, [F.col("_i")], {"_high": ("max", F.col("_scaled"))})
    return out.withColumn("p_holm", F.least(F.col("_high"), F.lit(1.0))).drop("_i", "_m", "_scaled", "_high")


def normalised_entropy(lists: DataFrame, by: Sequence[str], value: str = "prior") -> DataFrame:
    """Entropy of within-list shares over ln(n); null for one item or a zero sum.

    One aggregate: ln(S) - sum(x ln x) / S.
    """
    x = F.greatest(F.col(value), F.lit(0.0))
    total, n = F.sum(x), F.count(F.lit(1))
    inner = F.coalesce(F.sum(F.when(x > 0, x * F.log(x))), F.lit(0.0))
    entropy = F.try_divide(F.log(total) - F.try_divide(inner, total), F.log(n.cast("double")))
    return lists.groupBy(*by).agg(F.when((n >= 2) & (total > 0), entropy).alias("entropy"))


def concordance(items: Column, x: Callable[[Column], Column], y: Callable[[Column], Column]) -> Column:
    """Kendall tau-b of two values over a short array; null if undefined."""
    signs = pair_fold(items, lambda a, b: F.signum(x(a) - x(b)) * F.signum(y(a) - y(b)))
    tied_x = pair_fold(items, lambda a, b: F.when(x(a) == x(b), 1.0).otherwise(0.0))
    tied_y = pair_fold(items, lambda a, b: F.when(y(a) == y(b), 1.0).otherwise(0.0))
    pairs = pair_count(items).cast("double")
    # Integers until the last step, so that identical orders give exactly 1.
    return F.try_divide(signs, F.sqrt((pairs - tied_x) * (pairs - tied_y)))


def order_concordance(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Kendall concordance of two capped lists over their common items, and their count."""
    a = reference.select(QUERY, CAND, F.col("rank").alias("old"))
    both = current.select(QUERY, CAND, F.col("rank").alias("new")).join(a, [QUERY, CAND])
    packed = both.groupBy(QUERY).agg(F.array_sort(F.collect_list(F.struct("new", "old"))).alias("items"))
    tau = concordance(F.col("items"), lambda v: v["new"], lambda v: v["old"])
    return packed.select(QUERY, F.size("items").cast("long").alias("shared"),
                         F.when(F.size("items") >= 2, tau).alias("kendall"))


def list_descriptors(current: DataFrame, reference: DataFrame, truth: DataFrame,
                     similarity: Callable[[Column, Column], Column], distance: Callable[[Column, Column], Column],
                     value: str) -> DataFrame:
    """Seven descriptors of each capped list that holds the answer.

    length, jaccard and shared with the reference list, Kendall concordance, entropy, mean
    pair distance, largest similarity of another candidate to the answer.
    """
    kept = current.join(truth.select(QUERY, "truth_key"), QUERY)
    ref = reference.select(QUERY, CAND, F.col("rank").alias("old"))
    ref_size = reference.groupBy(QUERY).agg(F.max("n").alias("reference_length"))
    items = F.array_sort(F.collect_list(F.struct("rank", CAND, value, "old", "prior")))
    packed = kept.join(ref, [QUERY, CAND], "left").groupBy(QUERY, "truth_key").agg(items.alias("items"))
    packed = packed.withColumns({
        "common": F.filter("items", lambda v: v["old"].isNotNull()),
        "answer": F.filter("items", lambda v: v[CAND] == F.col("truth_key"))})
    answer = F.get("answer", F.lit(0))[value]
    others = F.filter("items", lambda v: v[CAND] != F.col("truth_key"))
    described = packed.filter(F.size("answer") > 0).join(ref_size, QUERY, "left").select(
        QUERY, F.size("items").cast("long").alias("length"),
        F.coalesce("reference_length", F.lit(0)).alias("reference_length"),
        F.size("common").cast("long").alias("shared"),
        F.when(F.size("common") >= 2, concordance(F.col("common"), lambda v: v["rank"], lambda v: v["old"])).alias("kendall"),
        F.when(F.size("items") >= 2, pair_fold(F.col("items"), lambda a, b: distance(a[value], b[value]))
               / pair_count(F.col("items"))).alias("pair_distance"),
        F.array_max(F.transform(others, lambda v: similarity(v[value], answer))).alias("near_miss"))
    described = described.withColumn(
        "jaccard", F.col("shared") / (F.col("length") + F.col("reference_length") - F.col("shared")))
    return described.join(normalised_entropy(kept, [QUERY]), QUERY)


def clipping(rows: DataFrame, normaliser: DataFrame, features: Sequence[str], clip: float = 5.0) -> DataFrame:
    """Share of rows clipped below and above per feature and in any, with a 10 % flag.

    ``normaliser`` is one row with m_<feature> and s_<feature>.
    """
    joined = with_row(rows, normaliser)
    z = {c: (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in features}
    below = [F.avg(F.when(z[c] < -clip, 1.0).otherwise(0.0)).alias(f"{c}_below") for c in features]
    above = [F.avg(F.when(z[c] > clip, 1.0).otherwise(0.0)).alias(f"{c}_above") for c in features]
    any_: Column = F.lit(False)
    for c in features:
        any_ = any_ | (F.abs(z[c]) > clip)
    share = F.avg(F.when(any_, 1.0).otherwise(0.0))
    return joined.agg(*below, *above, share.alias("any_clipped"), (share > 0.1).alias("flagged"))


def fit_normaliser(pairs: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and floored population deviation over stacked positives and negatives, as one row per group."""
    stacked = pairs.select(*by, *[F.col(f"pos_{c}").alias(c) for c in features]).unionByName(
        pairs.select(*by, *[F.col(f"neg_{c}").alias(c) for c in features]))
    return stacked.groupBy(*by).agg(
        *[F.avg(c).alias(f"m_{c}") for c in features],
        *[F.greatest(F.stddev_pop(c), F.lit(1e-6)).alias(f"s_{c}") for c in features])


def replicate_stability(rows: DataFrame, replicates: Sequence[int], by: Sequence[str]) -> DataFrame:
    """Agreement of every pair of replicates: difference distribution and correlations.

    ``rows`` has one column ``v_<replicate>`` per replicate; replicates are few and given.
    """
    out = None
    for i, a in enumerate(replicates):
        for b in replicates[i + 1:]:
            pair = rows.select(*by, F.col(f"v_{a}").alias("_a"), F.col(f"v_{b}").alias("_b"),
                               F.abs(F.col(f"v_{a}") - F.col(f"v_{b}")).alias("_d"))
            pair = pair.withColumns({"replicate_a": F.lit(a), "replicate_b": F.lit(b)})
            out = pair if out is None else out.unionByName(pair)
    keys = ["replicate_a", "replicate_b", *by]
    differences = distribution(out, keys, "_d")
    pearson = correlation(out, keys, "_a", "_b", least=2).select(*keys, F.col("correlation").alias("pearson"))
    spearman = correlation(out, keys, "_a", "_b", True, least=2).select(*keys, F.col("correlation").alias("spearman"))
    return differences.join(pearson, keys).join(spearman, keys)


def variation(rows: DataFrame, replicates: Sequence[int], epsilon: float = 1e-8) -> Column:
    """Sample deviation over absolute mean of the replicate columns; null for a tiny mean."""
    values = [F.col(f"v_{r}") for r in replicates]
    mean = sum(values[1:], values[0]) / len(values)
    square = sum([(v - mean) * (v - mean) for v in values[1:]], (values[0] - mean) * (values[0] - mean))
    return F.when(F.abs(mean) > epsilon, F.try_divide(F.sqrt(square / (len(values) - 1)), F.abs(mean)))


def average_replicates(rows: DataFrame, keys: Sequence[str], averaged: Sequence[str], fixed: Sequence[str]) -> DataFrame:
    """Mean over replicates of some columns; all others must not vary between replicates."""
    def constant(name: str) -> Column:
        same = F.count_distinct(F.struct(name)) == 1
        return F.when(same, F.min(name)).otherwise(F.raise_error(F.lit(f"{name} differs between replicates")).cast("double"))

    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in averaged], *[constant(c).alias(c) for c in fixed])


def score_diagnostics(scores: DataFrame, by: Sequence[str], score: str, prior: str) -> DataFrame:
    """Per list: deviation and range of a score, and its rank correlation with the prior."""
    by = list(by)
    spread = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop(score).alias("score_sd"), (F.max(score) - F.min(score)).alias("score_range"))
    rho = correlation(scores, by, score, prior, True, least=2).select(*by, F.col("correlation").alias("rho"))
    return spread.join(rho, by)


def diagnostic_summary(per_list: DataFrame, group: str, zero: float = 1e-12) -> DataFrame:
    """Counts of defined and signed correlations and mean spread, per group and pooled."""
    rho = F.col("rho")
    return per_list.rollup(group).agg(
        F.grouping(group).alias("pooled"), F.count(F.lit(1)).alias("n_lists"),
        F.count_if(F.col("n") == 1).alias("singletons"), F.count("rho").alias("defined"),
        F.count_if(rho > zero).alias("positive"), F.count_if(F.abs(rho) <= zero).alias("zero"),
        F.count_if(rho < -zero).alias("negative"), F.avg("score_sd").alias("mean_sd"),
        F.avg("score_range").alias("mean_range"), F.avg("rho").alias("mean_rho"))


def token_inventory(rows: DataFrame, column: str, separator: str = "[.]") -> tuple[DataFrame, DataFrame]:
    """(distinct trimmed tokens with use counts, one-row audit) of a text column."""
    parts = rows.select(F.explode(F.split(column, separator)).alias("raw"))
    trimmed = parts.select(F.trim("raw").alias("token"))
    distinct = trimmed.filter(F.col("token") != "").groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    audit = trimmed.groupBy("token").agg(F.count(F.lit(1)).alias("c")).agg(
        F.sum("c").alias("pieces"), F.coalesce(F.sum(F.when(F.col("token") == "", F.col("c"))), F.lit(0)).alias("empty"),
        F.count_if(F.col("token") != "").alias("distinct_tokens"))
    return distinct, audit


def hash_sample(population: DataFrame, key: str, stratum: str, n: int, seed: int, census: Sequence[str] = ()) -> DataFrame:
    """First n per stratum in the order of sha256(seed NUL key); whole census strata."""
    drawn = population.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}\0"), F.col(key).cast("string")), 256))
    window = Window.partitionBy(stratum).orderBy("_h", key)
    fixed = drawn.filter(~F.col(stratum).isin(*census)) if census else drawn
    taken = fixed.withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= n).drop("_r")
    if census:
        taken = taken.unionByName(drawn.filter(F.col(stratum).isin(*census)))
    return taken.drop("_h")


def disjoint_warmup(population: DataFrame, sample: DataFrame, key: str, stratum: str, strata: Sequence[str], n: int, seed: int) -> DataFrame:
    """Round-robin picks from given strata, disjoint from the sample."""
    free = population.join(sample.select(key), key, "left_anti").filter(F.col(stratum).isin(*strata))
    drawn = free.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed + 1}\0"), F.col(key).cast("string")), 256))
    window = Window.partitionBy(stratum).orderBy("_h", key)
    turns = drawn.withColumn("_turn", F.row_number().over(window)).filter(F.col("_turn") <= n)
    place = F.lit(len(strata))
    for i, name in enumerate(strata):
        place = F.when(F.col(stratum) == name, i).otherwise(place)
    return turns.orderBy("_turn", place).limit(n).drop("_h", "_turn")


def expansion(batches: DataFrame, population: DataFrame, stratum: str) -> DataFrame:
    """Post-stratified total per stratum with an engineering range.

    ``batches`` has (stratum, attempted, cost); ``population`` has (stratum, population).
    """
    rate = F.try_divide(F.col("cost"), F.col("attempted"))
    per = batches.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("batches"), F.sum("attempted").alias("attempted"), F.sum("cost").alias("cost"),
        F.min(rate).alias("_low"), F.max(rate).alias("_high"))
    size = F.col("population")
    return population.join(per, stratum, "left").select(
        stratum, "population", F.coalesce("attempted", F.lit(0)).alias("attempted"),
        F.coalesce(size * F.try_divide(F.col("cost"), F.col("attempted")), F.lit(0.0)).alias("estimate"),
        F.coalesce(size * F.col("_low"), F.lit(0.0)).alias("lower"),
        F.coalesce(size * F.col("_high") * 1.25, F.lit(0.0)).alias("upper"))


def case_studies(paired: DataFrame, n: int = 6) -> DataFrame:
    """Pick example queries without reuse, category after category.

    ``paired`` has per query: promoted, lost, gain, before (mean ranks over seeds).  Every
    category needs at most n candidates, so only the top few of each are looked at.
    """
    gain, promoted, lost = F.col("gain"), F.col("promoted"), F.col("lost")
    always = F.lit(True)
    plan = [
        ("promoted_to_top1", promoted > 0, [-promoted, -gain, F.col(QUERY)], 2),
        ("large_improvement", (gain > 0) & (promoted == 0), [-gain, F.col(QUERY)], 1),
        ("unchanged", (gain == 0) & (F.col("before") > 1), [F.col(QUERY)], 1),
        ("lost_top1", lost > 0, [-lost, gain, F.col(QUERY)], 1),
        ("degraded", gain < 0, [gain, F.col(QUERY)], 1),
        ("additional", always, [-gain, F.col(QUERY)], n),
    ]
    chosen: list[tuple] = []
    for category, condition, order, count in plan:
        quota = min(count, n - len(chosen))
        if quota <= 0:
            continue
        # A handful of rows: the feature is a short report.
        top = paired.filter(condition).orderBy(*order).limit(n + quota).select(QUERY, "promoted", "lost", "gain", "before").collect()
        used = {c[1] for c in chosen}
        fresh = [r for r in top if r[QUERY] not in used][:quota]
        chosen += [(category, *r) for r in fresh]
    types = {f.name: f.dataType.simpleString() for f in paired.schema.fields}
    schema = "category STRING, " + ", ".join(f"{c} {types[c]}" for c in (QUERY, "promoted", "lost", "gain", "before"))
    return paired.sparkSession.createDataFrame(chosen, schema)


def equivalence(intervals: DataFrame, margins: dict[str, float]) -> DataFrame:
    """Equivalence, superiority and inferiority per metric, and per comparison on all metrics.

    ``intervals`` has (comparison, metric, low, high, low90, high90).
    """
    margin = F.create_map(*[x for k, v in margins.items() for x in (F.lit(k), F.lit(v))])[F.col("metric")]
    flagged = intervals.withColumns({
        "equivalent": (F.col("low90") > -margin) & (F.col("high90") < margin),
        "superior": F.col("low") > 0, "inferior": F.col("high") < 0})
    both = flagged.groupBy("comparison").agg(
        F.bool_and("equivalent").alias("all_equivalent"), F.bool_and("superior").alias("all_superior"),
        F.bool_and("inferior").alias("all_inferior"))
    verdict = (F.when(F.col("all_equivalent"), "equivalent").when(F.col("all_superior"), "superior")
               .when(F.col("all_inferior"), "inferior").otherwise("inconclusive"))
    return flagged.join(both.select("comparison", verdict.alias("verdict")), "comparison")
