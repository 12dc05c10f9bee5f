"""Column helpers for similarities, vector maths and normalised scores. No Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(left: Column, right: Column) -> Column:
    """Set overlap of two arrays; 0 when either is empty."""
    either_empty = (F.size(left) <= 0) | (F.size(right) <= 0)
    ratio = F.size(F.array_intersect(left, right)).cast("double") / F.size(F.array_union(left, right))
    return F.when(either_empty, F.lit(0.0)).otherwise(ratio)


def term_match(text: Column, terms: Column) -> Column:
    """Share of `terms` that occur in `text` as plain substrings; 0 without terms."""
    hits = F.aggregate(terms, F.lit(0), lambda acc, term: acc + F.contains(text, term).cast("int"))
    return F.when(F.size(terms) > 0, hits.cast("double") / F.size(terms)).otherwise(F.lit(0.0))


def token_overlap(tokens: Column, terms: Column) -> Column:
    """Share of `terms` found among `tokens`; 0 without terms."""
    hits = F.size(F.array_intersect(tokens, terms)).cast("double")
    return F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(F.lit(0.0))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """(value - low) / (high - low); 1 when the range is empty."""
    return F.when(high <= low, F.lit(1.0)).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def rounded_scaled(value: Column, digits: int) -> Column:
    """`value` rounded half away from zero once it is scaled: 0.45 stays a tie where 100 * 0.0045 falls just below it."""
    return F.round(value * 10.0**digits) / 10.0**digits


def floor_at_zero(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def norm(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def unit(vector: Column) -> Column:
    """L2-normalised vector in double precision; a zero vector stays as it is."""
    length = norm(vector)
    return F.transform(vector, lambda x: x.cast("double") / F.when(length > 0, length).otherwise(F.lit(1.0)))


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def is_finite(vector: Column) -> Column:
    infinity = F.lit(float("inf"))
    return F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x.cast("double")) < infinity))


def vector_to_text(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda x: x.cast("string")), "|")


def text_to_vector(text: Column) -> Column:
    return F.transform(F.split(text, r"\|"), lambda x: x.try_cast("float"))


def ab_group(experiment: Column, user_id: Column) -> Column:
    """Stable A/B group from the first 8 hex digits of sha256('experiment:user')."""
    digest = F.sha2(F.concat(experiment, F.lit(":"), user_id.cast("string")).cast("binary"), 256)
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 2
    return F.when(bucket == 0, F.lit("A")).otherwise(F.lit("B"))
