"""Column expressions that derive labels, names and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_part(x: Column) -> Column:
    """A name after its last slash."""
    return F.substring_index(x, "/", -1)


def size_in_billions(x: Column) -> Column:
    """The number before a B, as in 27B; null if there is none."""
    return F.regexp_extract(x, r"(?i)([0-9]+(?:\.[0-9]+)?)b", 1).try_cast("double")


def base_name(x: Column) -> Column:
    """A variant's name without the suffix of its mode."""
    return F.regexp_replace(x, "(_no_think|_think)$", "")


def method_of(x: Column) -> Column:
    return F.when(F.endswith(x, F.lit("_no_think")), "no_think").when(F.endswith(x, F.lit("_think")), "think").otherwise("standard")


def combination(kind: Column, index: Column, none: str) -> Column:
    """``kind_idx<n>``; the sentinel where the kind is null or empty or the index is negative or null."""
    return F.when(kind.isNull() | (kind == "") | index.isNull() | (index < 0), F.lit(none)).otherwise(F.concat(kind, F.lit("_idx"), index.cast("string")))


def sort_key(x: Column) -> Column:
    """(family, size) of a model's name: letters before the first mark or digit, and the number before B or M, else 0."""
    family = F.lower(F.regexp_extract(last_part(x), r"^[^-_0-9]*", 0))
    size = F.regexp_extract(x, r"([0-9]+\.?[0-9]*)\s*[BbMm]", 1).try_cast("double")
    return F.struct(family.alias("family"), F.coalesce(size, F.lit(0.0)).alias("size"))


def polarity(x: Column) -> Column:
    """The name of a sentiment of -1 or 1; null for others."""
    return F.when(x == -1, "NEGATIVE").when(x == 1, "POSITIVE")


def chosen_text(keys: Column, texts: Column, chosen: Column) -> Column:
    """The text of the option whose key was chosen; of equal keys the last counts."""
    at = F.size(keys) - F.array_position(F.reverse(keys), chosen) + 1
    return F.when(F.array_contains(keys, chosen), F.get(texts, (at - 1).cast("int")))


def integer_or(x: Column, default: int = -1) -> Column:
    return F.coalesce(x.try_cast("int"), F.lit(default))


def decile(p: Column) -> Column:
    """Bin 0 to 9 of a probability; 1.0 is in bin 9."""
    return F.least(F.floor(p * 10), F.lit(9)).cast("int")


def confusion(gold: Column, predicted: Column) -> dict[str, Column]:
    return {"tp": gold & predicted, "fp": ~gold & predicted, "fn": gold & ~predicted, "tn": ~gold & ~predicted}


def outcome(before: Column, after: Column, comparable: Column | None = None) -> Column:
    """Class of a matched pair by who is right; ``not_comparable`` where that is told."""
    out = F.when(comparable.isNull() | ~comparable, "not_comparable") if comparable is not None else F
    return out.when(~before & after, "rescue").when(before & ~after, "harm").when(before & after, "both_correct").otherwise("both_incorrect")


def direction(x: Column) -> Column:
    """Of a difference right minus left."""
    return F.when(x > 0, "right_more").when(x < 0, "left_more").otherwise("tie")


def sign_match(x: Column, target: Column, tolerance: float = 0.35) -> Column:
    """Whether a coordinate has the target's sign; for target 0, whether it is near 0."""
    return F.when(target == 0, F.abs(x) <= tolerance).otherwise(x * target > 0)


def recurrence(informative: Column, substantive: Column, models: Column, parent_families: Column) -> Column:
    """How widely a contrast recurs."""
    # The five classes.
    return (
        F.when(~informative, "uninformative_low_exposure")
        .when(~substantive, "no_substantive_pocket")
        .when(parent_families >= 2, "cross_family_recurrence")
        .when(models >= 2, "within_family_recurrence")
        .otherwise("isolated_model_pocket")
    )


#: What an error message contains, and its family; the first that fits counts.
ERROR_FAMILIES = [
    ("OutOfMemoryError", "oom"),
    ("CUDA out of memory", "oom"),
    ("EngineCore encountered an issue", "engine_core"),
    ("classification_generate_failed", "classification_generate"),
    ("missing_prompt_logprob_for_candidate", "missing_prompt_logprob"),
    ("candidate_key_tokenized_to_empty_suffix_in_context", "tokenization_suffix"),
    ("worker_config_failed", "worker_config_failed"),
    ("stage1_generation_failed", "stage1_generation_failed"),
]


def error_family(x: Column) -> Column:
    """A message's family by what it contains; ``success`` without a message."""
    out = F.when(x.isNull() | (x == ""), "success")
    for part, family in ERROR_FAMILIES:
        out = out.when(x.contains(part), family)
    return out.otherwise("other")


def p_text(log10p: Column) -> Column:
    """A p-value from its log10: three significant digits above 1e-4, else the power of ten."""
    p = F.pow(F.lit(10.0), log10p)
    digits = F.round(p, 6)
    for places in (5, 4, 3, 2):
        digits = F.when(p >= 10.0 ** (2 - places), F.round(p, places)).otherwise(digits)
    plain = F.regexp_replace(digits.cast("decimal(12,6)").cast("string"), r"\.?0+$", "")
    return F.when(log10p.isNull() | F.isnan(log10p), "n/a").when(log10p > -4, plain).otherwise(F.concat(F.lit("1e"), F.rint(log10p).cast("long").cast("string")))


def depth_relation(context: Column, mode: Column) -> Column:
    """How a context that discourages depth (0 to 2) meets the reasoning mode."""
    # The six relations.
    against = context.isin(0, 1, 2)
    return (
        F.when(against & (mode == "think"), "conflicting")
        .when(against & (mode == "short"), "congruent_short")
        .when(context == -1, "no_context")
        .when(context == 3, "anti_correction_context")
        .when(context == 4, "spatial_context")
        .otherwise("neutral_or_mixed")
    )


def rank_of(x: Column, order: list[str]) -> Column:
    """Place of a category in a given order; those outside it come last."""
    out = F.when(x == order[0], 0)
    for k, v in enumerate(order[1:], 1):
        out = out.when(x == v, k)
    return out.otherwise(len(order))


# The quadrant that a persona stands for, as signs of (economic, social).
TARGET_SIGNS = {"libertarian_left": (-1, -1), "libertarian_right": (1, -1), "authoritarian_left": (-1, 1), "authoritarian_right": (1, 1)}


def looked_up(key: Column, values: dict) -> Column:
    """The value that a closed table holds for a key; null where it holds none, or the key is null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def target_signs(persona: Column) -> tuple[Column, Column]:
    """Economic and social sign of a persona's quadrant; null for those that have none."""
    return tuple(looked_up(persona, {k: v[axis] for k, v in TARGET_SIGNS.items()}) for axis in (0, 1))
