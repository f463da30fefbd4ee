"""Column expressions on probability arrays and candidate maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence(probabilities: Column) -> Column:
    """The largest probability of an array, without nulls and NaN; null if there is none."""
    return F.array_max(F.filter(probabilities, lambda p: p.isNotNull() & ~F.isnan(p)))


def unique_union(*lists: Column) -> Column:
    """The elements of several lists, each once, in order of first appearance."""
    return F.array_distinct(F.concat(*lists))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, not at each element that a lambda sees."""
    return F.transform(F.array(value), body)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def clean(x: Column) -> Column:
    """NaN as null: what aggregates must skip."""
    return F.nanvl(x, F.lit(None).cast("double"))


def softmax(x: Column) -> Column:
    """Stable softmax of an array."""
    raised = bound(x, lambda y: F.transform(y, lambda v: F.exp(v - F.array_max(y))))
    return bound(raised, lambda y: bound(total(y), lambda t: F.transform(y, lambda v: v / t)))


def softmax_map(logs: Column) -> Column:
    """Stable softmax of a map from candidate to log score."""
    return F.map_from_arrays(F.map_keys(logs), softmax(F.map_values(logs)))


def entropy(p: Column) -> Column:
    """Natural-log entropy over the positive finite entries."""
    good = F.filter(p, lambda v: v.isNotNull() & ~F.isnan(v) & (v > 0))
    return F.aggregate(good, F.lit(0.0), lambda s, v: s - v * F.ln(v))


def margin(p: Column) -> Column:
    """Largest minus second largest; null with fewer than two."""
    ordered = F.sort_array(p, asc=False)
    return F.try_element_at(ordered, F.lit(1)) - F.try_element_at(ordered, F.lit(2))


def dot(p: Column, w: Column) -> Column:
    return total(F.zip_with(p, w, lambda a, b: a * b))


def centred(w: Column) -> Column:
    return bound(w, lambda y: bound(total(y) / F.size(y), lambda m: F.transform(y, lambda v: v - m)))


def canonical(p: Column, permutation: Column) -> Column:
    """Displayed order undone (reversed for 2 and 3) and renormalised; null if the sum isn't positive."""
    q = F.when(permutation.isin(2, 3), F.reverse(p)).otherwise(p)
    return bound(q, _shares)


def _shares(x: Column) -> Column:
    return bound(total(x), lambda t: F.when(t > 0, F.transform(x, lambda v: v / t)))


def variation_distance(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: F.abs(a - b))) * 0.5


def first_argmax(p: Column) -> Column:
    """Place (from 0) of the first largest entry."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def expected_place(p: Column) -> Column:
    return F.aggregate(F.transform(p, lambda v, k: v * k), F.lit(0.0), lambda s, v: s + v)


def dispersion(p: Column) -> Column:
    """Sum of p(1 - p)."""
    return F.aggregate(p, F.lit(0.0), lambda s, v: s + v * (1 - v))


def weight_variance(p: Column, w: Column, floor: bool = True) -> Column:
    """Variance of the weights under p; at least 0 unless ``floor`` is off."""
    mean = dot(p, w)
    value = dot(p, F.transform(w, lambda v: v * v)) - mean * mean
    return F.greatest(value, F.lit(0.0)) if floor else value


def nan_mean(*columns: Column) -> Column:
    """Mean of those that are neither null nor NaN."""
    good = F.filter(F.array(*columns), lambda v: v.isNotNull() & ~F.isnan(v))
    return F.try_divide(total(good), F.size(good).cast("double"))


def candidate_distribution(keys: Column, texts: Column, probs: Column, canon: Column) -> Column:
    """Probabilities in the order of the canonical labels, matched without regard to case; null if none matches."""
    by_label = F.transform(canon, lambda c: F.aggregate(F.zip_with(keys, texts, lambda k, t: F.when(F.lower(F.trim(t)) == F.lower(F.trim(c)), F.try_element_at(probs, k))), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))))
    return bound(by_label, _shares)


def one_hot(answer: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (answer == k).cast("int"))
