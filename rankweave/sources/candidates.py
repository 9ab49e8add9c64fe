"""Scans of candidate files and query tables, with audits of what was rejected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.keys import set_key, single_key
from rankweave.functions.scores import normalised_rank
from rankweave.operators import pools as P
from rankweave.scale import ranked

REACTION_SCHEMA = "reactants_smiles STRING, products_smiles STRING, `set` STRING"
CANDIDATE_SCHEMA = "product STRING, reactant STRING, prior DOUBLE, label INT"
REQUIRED = ("product", "reactant", "prior")
# Python-style float text; anything else does not count as a number.
_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines numbered from 1 through all files of ``path``, in order of file name and place in the file."""
    return in_file_order(spark.read.text(path), "line_no")


def in_file_order(rows: DataFrame, number: str) -> DataFrame:
    """Rows of a file scan numbered from 1 by file path, split offset and place in the split.

    Spark packs splits into tasks by size, so the order of tasks alone says nothing about files.
    """
    placed = rows.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start",
                                       F.monotonically_increasing_id().alias("at")).alias("_place"))
    order = [F.col("_place.file_path"), F.col("_place.file_block_start"), F.col("_place.at")]
    return ranked(placed, [], order, number).drop("_place")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail at plan time when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def classify(lines: DataFrame) -> DataFrame:
    """Parse candidate lines (value, line_no) once and give each a status.

    blank, malformed_json, non_object_json, missing_required_fields, invalid_prior,
    nonfinite_prior, invalid_product, invalid_reactant or ok.
    """
    # Each stage passes through a one-element explode: filters on its results are then not
    # rewritten into repeated parsing of the same line.
    parsed = lines.select("line_no", "value", F.explode(F.array(F.try_parse_json(F.trim("value")))).alias("_v"))
    absent: Column | None = None
    for name in REQUIRED:
        gone = F.try_variant_get("_v", f"$.{name}", "variant").isNull()
        absent = gone if absent is None else absent | gone
    fields = F.struct(
        F.col("_v").isNull().alias("_bad"),
        (~F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))).alias("_other"),
        absent.alias("_absent"),
        *[F.try_variant_get("_v", f"$.{name}", "string").alias(f"_{name}") for name in REQUIRED])
    opened = parsed.select("line_no", "value", F.inline(F.array(fields)))
    number = F.when(F.col("_prior").rlike(_NUMBER), F.trim("_prior").try_cast("double"))
    keyed = F.struct(number.alias("prior"), single_key("_product").alias("product_key"),
                     set_key("_reactant").alias("cand_key"))
    staged = opened.select(
        "line_no", "value", "_bad", "_other", "_absent", F.col("_product").alias("raw_product"),
        F.col("_reactant").alias("raw_reactant"), F.inline(F.array(keyed)))
    finite = ~F.isnan("prior") & (F.abs("prior") != F.lit(float("inf")))
    status = (
        F.when(F.trim("value") == "", "blank").when(F.col("_bad"), "malformed_json")
        .when(F.col("_other"), "non_object_json").when(F.col("_absent"), "missing_required_fields")
        .when(F.col("prior").isNull(), "invalid_prior").when(~finite, "nonfinite_prior")
        .when(F.col("product_key").isNull(), "invalid_product")
        .when(F.col("cand_key").isNull(), "invalid_reactant").otherwise("ok")
    )
    return staged.withColumn("status", status).drop("_bad", "_other", "_absent")


def accepted(classified: DataFrame) -> DataFrame:
    """Valid lines as a raw pool keyed by product."""
    return classified.filter(F.col("status") == "ok").select(
        F.col("product_key").alias("query_id"), "cand_key", "prior", "line_no", "raw_reactant")


def rejected(classified: DataFrame) -> DataFrame:
    """Records whose key is invalid; they must reproduce exactly between two files."""
    return classified.filter(F.col("status").isin("invalid_product", "invalid_reactant")).select(
        "line_no", "status", "product_key", "raw_product", "raw_reactant", "prior")


def fatal(classified: DataFrame) -> DataFrame:
    """Lines that make a file unusable, with their kind."""
    kinds = ("malformed_json", "non_object_json", "missing_required_fields", "invalid_prior",
             "nonfinite_prior")
    return classified.filter(F.col("status").isin(*kinds)).select("line_no", "status")


def scan_audit(classified: DataFrame) -> DataFrame:
    """The twelve audit counters of one file, as one row."""
    def counted(*names: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("status").isin(*names), F.col("k"))), F.lit(0))

    # One pass over the text: duplicates, candidates and products are counted level by level.
    kept = F.col("status") == "ok"
    per_candidate = classified.groupBy("status", "product_key", "cand_key").agg(F.count(F.lit(1)).alias("k"))
    per_product = per_candidate.groupBy("status", "product_key").agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("c"))
    return per_product.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("physical_lines"), counted("blank").alias("blank_lines"),
        counted("ok", "invalid_product", "invalid_reactant").alias("candidate_records"),
        counted("malformed_json", "non_object_json").alias("malformed_json_lines"),
        counted("missing_required_fields").alias("missing_required_fields"),
        counted("invalid_prior").alias("invalid_prior_records"),
        counted("nonfinite_prior").alias("nonfinite_prior_records"),
        counted("invalid_product").alias("invalid_product_records"),
        counted("invalid_reactant").alias("invalid_reactant_records"),
        F.coalesce(F.sum(F.when(kept, F.col("k") - F.col("c"))), F.lit(0)).alias("canonical_duplicate_records"),
        F.count_if(kept).alias("unique_products"),
        F.coalesce(F.sum(F.when(kept, F.col("c"))), F.lit(0)).alias("unique_candidates"))


def tolerant_audit(classified: DataFrame) -> DataFrame:
    """Counters of the tolerant scan: blanks skipped, malformed and invalid counted."""
    return classified.agg(
        F.count_if(F.col("status") != "blank").alias("lines"),
        F.count_if(F.col("status").isin("malformed_json", "non_object_json")).alias("malformed"),
        F.count_if(~F.col("status").isin("blank", "malformed_json", "non_object_json", "ok")).alias("invalid"),
        F.count_if(F.col("status") == "ok").alias("kept"))


def labelled_lists(rows: DataFrame) -> DataFrame:
    """Labelled rows grouped by raw product, with a stable 0-based prior rank."""
    kept = rows.filter((F.trim("product") != "") & (F.trim("reactant") != ""))
    placed = ranked(kept, ["product"], [-F.col("prior"), F.col("line_no"), F.col("reactant")], "rank", "n")
    return placed.withColumn("rank", F.col("rank") - 1)


def load_reactions(source: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Query rows with keys; rows without a product or answer key are flagged, not lost.

    ``source`` has (id, products_smiles, reactants_smiles, set).  Optional metadata has a
    unique ``reaction_id`` with ``source_split`` and ``reaction_class``; a repeated one is an error.
    """
    require_columns(source, ("id", "products_smiles", "reactants_smiles", "set"))
    keyed = source.select(
        F.col("id").alias("query_id"), F.col("set").alias("split"),
        single_key("products_smiles").alias("product_key"),
        set_key("reactants_smiles").alias("truth_key"))
    if metadata is not None:
        once = metadata.groupBy(F.col("reaction_id").alias("query_id")).agg(
            F.count(F.lit(1)).alias("_n"), F.first("source_split").alias("source_split"), F.first("reaction_class").alias("reaction_class"))
        twice = F.raise_error(F.lit("a reaction id occurs twice in the metadata")).cast(once.schema["reaction_class"].dataType)
        keyed = keyed.join(once, "query_id", "left").withColumn("reaction_class", F.when(
            F.coalesce("_n", F.lit(1)) == 1, F.col("reaction_class")).otherwise(twice)).drop("_n")
        agrees = F.col("source_split").isNull() | (F.col("source_split") == F.col("split"))
        keyed = keyed.withColumn(
            "split", F.when(agrees, F.col("split"))
            .otherwise(F.raise_error(F.lit("split differs between source and metadata"))))
    return keyed.withColumn("usable", F.col("product_key").isNotNull() & F.col("truth_key").isNotNull())


def inventory(rows: DataFrame, key: str, line: str, limit: int | None = None) -> DataFrame:
    """Distinct keys in first-seen order with contiguous ranks from 0."""
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(line).alias("first_seen"))
    placed = ranked(first, [], [F.col("first_seen"), F.col(key)], "product_rank")
    placed = placed.withColumn("product_rank", F.col("product_rank") - 1)
    return placed if limit is None else placed.filter(F.col("product_rank") < limit)


def target_prefix(stored: DataFrame, targets: DataFrame, k: int = 10) -> DataFrame:
    """First k stored rows of the target queries only."""
    return stored.filter(F.col("rank") <= k).join(targets, "query_id", "left_semi")


def decode_cells(lines: DataFrame, cap: int, cell: str = r"^\('([^']*)', ([0-9.eE+-]+)\)$") -> DataFrame:
    """Decode tab-separated ``('candidate', score)`` cells into ordered lists.

    Invalid cells are dropped; per identity the best score wins and brings its own
    position, unlike ``dedupe``; the list is cut at ``cap`` and gets a rank prior.
    """
    cells = lines.select("query_id", F.posexplode(F.split("value", "\t")).alias("pos", "cell"))
    parsed = cells.select(
        "query_id", "pos", set_key(F.regexp_extract("cell", cell, 1)).alias("cand_key"),
        F.regexp_extract("cell", cell, 2).try_cast("double").alias("score"))
    best = (
        parsed.filter(F.col("cand_key").isNotNull() & F.col("score").isNotNull())
        .groupBy("query_id", "cand_key")
        .agg(F.max(F.struct("score", (-F.col("pos")).alias("neg"))).alias("b"))
        .select("query_id", "cand_key", F.col("b.score").alias("score"), (-F.col("b.neg")).alias("pos"))
    )
    top = P.top_list(best, cap, order=[F.col("score").desc(), F.col("pos")])
    return top.withColumn("prior", normalised_rank(F.col("rank"), F.col("n")))


def decode_audit(lines: DataFrame, cell: str = r"^\('([^']*)', ([0-9.eE+-]+)\)$") -> DataFrame:
    """Counts of cells and invalid cells."""
    good = F.col("cell").rlike(cell) & (F.regexp_extract("cell", cell, 1) != "")
    return lines.select(F.explode(F.split("value", "\t")).alias("cell")).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(~good).alias("invalid_cells"))


def lists_from_json(rows: DataFrame, column: str) -> DataFrame:
    """Rebuild lists from a JSON array column, with evenly spaced priors from 1 to 0."""
    items = rows.select("query_id", F.from_json(column, "array<string>").alias("items"))
    return items.select(
        "query_id", F.size("items").cast("long").alias("n"), F.posexplode("items").alias("pos", "cand_key")
    ).select("query_id", "cand_key", (F.col("pos") + 1).cast("long").alias("rank"), "n").withColumn(
        "prior", normalised_rank(F.col("rank"), F.col("n")))


def read_reactions(spark: SparkSession, path: str, metadata_path: str | None = None) -> DataFrame:
    """Query rows from a CSV file with a header; the id is the zero-based row number.

    A header that does not have the required columns is an error.
    """
    raw = (
        spark.read.schema(REACTION_SCHEMA).option("header", "true").option("enforceSchema", "false")
        .option("mode", "FAILFAST").csv(path)
    )
    numbered = in_file_order(raw, "id").withColumn("id", F.col("id") - 1)
    metadata = None
    if metadata_path is not None:
        metadata = spark.read.schema("reaction_id LONG, source_split STRING, reaction_class INT").option(
            "header", "true").csv(metadata_path)
    return load_reactions(numbered, metadata)


def read_candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ordered lists, audit) of a candidate JSONL file, tolerant of bad lines."""
    parsed = classify(read_lines(spark, path))
    return P.full_list(P.dedupe(accepted(parsed))), scan_audit(parsed)
