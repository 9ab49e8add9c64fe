"""Identity keys and token functions on string columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "[.]"


def text(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def tokens(column: Column | str, separator: str = SEPARATOR) -> Column:
    """Trimmed, non-empty tokens in stored order."""
    parts = F.transform(F.split(text(column), separator), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def set_key(
    column: Column | str,
    normalise: Callable[[Column], Column] | None = None,
    keep_invalid: bool = False,
) -> Column:
    """Order-free key of a token multiset: normalised, sorted, joined with '.'.

    Null when there is no token or one normalises to null; ``keep_invalid`` keeps the
    raw token instead.
    """
    raw = tokens(column)
    done = raw
    if normalise is not None:
        def one(token: Column) -> Column:
            return F.coalesce(normalise(token), token) if keep_invalid else normalise(token)
        done = F.transform(raw, one)
    invalid = F.exists(done, lambda t: t.isNull()) | (F.size(done) == 0)
    return F.when(~invalid, F.array_join(F.array_sort(done), "."))


def single_key(column: Column | str) -> Column:
    """Lower-cased trimmed value, null when empty."""
    return F.nullif(F.lower(F.trim(text(column))), F.lit(""))


def letters_only(token: Column) -> Column:
    """Coarse token form: lower case letters and digits only, null when none is left."""
    return F.nullif(F.regexp_replace(F.lower(token), "[^a-z0-9]", ""), F.lit(""))


def same_up_to_case(left: Column | str, right: Column | str) -> Column:
    """Coarse keys equal although the exact keys differ."""
    coarse = set_key(left, letters_only) == set_key(right, letters_only)
    return F.coalesce(coarse & (set_key(left) != set_key(right)), F.lit(False))


def digest(column: Column | str) -> Column:
    """SHA-256 of the text, as lower-case hexadecimal."""
    return F.sha2(text(column), 256)


def overlap_similarity(left: Column, right: Column) -> Column:
    """Shared over combined distinct elements of two arrays; 0 for missing or empty."""
    union = F.size(F.array_union(left, right))
    shared = F.size(F.array_intersect(left, right))
    valid = left.isNotNull() & right.isNotNull() & (union > 0)
    return F.when(valid, shared / union).otherwise(F.lit(0.0))


def size_ratio(parts: Column, whole: Column) -> Column:
    """Total length of ``parts`` over the length of ``whole``; 1 for an empty whole."""
    total = F.aggregate(parts, F.lit(0), lambda acc, t: acc + F.length(t))
    return F.when(F.length(whole) == 0, F.lit(1.0)).otherwise(total / F.length(whole))


def size_penalty(parts: Column, whole: Column) -> Column:
    """Absolute size difference over the larger of the whole's size and 1."""
    total = F.aggregate(parts, F.lit(0), lambda acc, t: acc + F.length(t))
    return F.abs(total - F.length(whole)) / F.greatest(F.length(whole), F.lit(1))


def split_structured(column: Column | str, mark: str = ">") -> Column:
    """(left, middle, right) of a text with exactly two marks, else null."""
    parts = F.split(text(column), mark)
    return F.when(F.size(parts) == 3, F.struct(
        parts[0].alias("left"), parts[1].alias("middle"), parts[2].alias("right")))


def tagged_class(column: Column | str, low: int = 1, high: int = 10) -> Column:
    """Integer of a leading ``<RX_n>`` tag, null when absent or out of range."""
    value = F.regexp_extract(text(column), r"<RX_(\d+)>", 1).try_cast("int")
    return F.when(value.between(low, high), value)


def drop_listed(parts: Column, listed: list[str]) -> Column:
    """Remove listed tokens, but never all of them."""
    kept = F.filter(parts, lambda t: ~t.isin(listed))
    return F.when(F.size(kept) == 0, parts).otherwise(kept)


def removal_status(parts: Column, listed: list[str]) -> Column:
    """'invalid', 'empty', 'changed' or 'unchanged' for ``drop_listed``."""
    return (
        F.when(parts.isNull(), "invalid")
        .when(F.size(parts) == 0, "empty")
        .when(F.size(drop_listed(parts, listed)) < F.size(parts), "changed")
        .otherwise("unchanged")
    )


def normalise_distinct(
    df: DataFrame, column: str, output: str, normalise: Callable[[Column], Column]
) -> DataFrame:
    """Apply an expensive normaliser once per distinct value and join the results back."""
    mapping = df.select(column).distinct().withColumn(output, normalise(F.col(column)))
    return df.join(mapping, column, "left")
