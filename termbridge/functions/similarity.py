"""Similarity of two texts or two vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(word_list(text))


def jaccard_tokens(a: Column, b: Column) -> Column:
    """Shared share of all distinct words; 0 when neither text has words."""
    left, right = token_set(a), token_set(b)
    both = F.size(F.array_intersect(left, right)).cast("double")
    return F.coalesce(F.try_divide(both, F.size(left) + F.size(right) - both), F.lit(0.0))


def dice_tokens(a: Column, b: Column) -> Column:
    left, right = token_set(a), token_set(b)
    both = F.size(F.array_intersect(left, right)).cast("double")
    return F.coalesce(F.try_divide(2.0 * both, F.size(left) + F.size(right)), F.lit(0.0))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 when both texts are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        1.0 - F.try_divide(F.levenshtein(a, b).cast("double"), longest)
    )


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(vec: Column) -> Column:
    return F.sqrt(
        F.aggregate(vec, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def l2_normalize(vec: Column) -> Column:
    """Divide by the length; a zero vector stays as it is."""
    norm = F.array(F.when(l2_norm(vec) == 0.0, F.lit(1.0)).otherwise(l2_norm(vec)))
    return F.flatten(F.transform(norm, lambda n: F.transform(vec, lambda x: x.cast("double") / n)))


def cos_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when one of them is zero."""
    return F.coalesce(F.try_divide(inner_product(a, b), l2_norm(a) * l2_norm(b)), F.lit(0.0))
