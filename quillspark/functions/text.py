"""Column expressions on text: normalising, splitting traces, counting words and lexicon matches, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(?U)\b[\w'-]+\b"
#: A word in ASCII letters, for results that an RE2 engine must repeat.
ASCII_WORD = r"[A-Za-z']+"


def _trimmed(x: Column) -> Column:
    """As a function of one argument: an array function would pass a second one its index."""
    return F.trim(x)


def squeezed(x: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def hidden_and_visible(x: Column) -> Column:
    """Struct (hidden, visible, has_hidden) of a trace with ``<think>`` parts; an unclosed part hides the rest."""
    closed = r"(?is)<think>(.*?)</think>"
    rest = F.regexp_replace(x, closed, "")
    opened = F.regexp_extract(rest, r"(?is)<think>(.*)$", 1)
    hidden = F.concat_ws("\n", F.transform(F.regexp_extract_all(x, F.lit(closed), F.lit(1)), _trimmed), F.when(F.trim(opened) != "", F.trim(opened)))
    visible = F.trim(F.regexp_replace(rest, r"(?is)<think>.*$", ""))
    return F.struct(hidden.alias("hidden"), visible.alias("visible"), x.rlike(r"(?i)<think>").alias("has_hidden"))


def word_count(x: Column, pattern: str = WORD) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def last_lines(x: Column, k: int) -> Column:
    """The last k lines with other than white space, trimmed."""
    lines = F.filter(F.transform(F.split(x, "\n"), _trimmed), lambda s: s != "")
    return F.slice(lines, F.greatest(F.lit(1), F.size(lines) - k + 1), F.lit(k))


def rationale(x: Column, statement: Column, prefixes: list[str]) -> Column:
    """The text without the statement and without lines that begin with one of the prefixes."""
    rest = F.split(F.replace(x, statement, F.lit("")), "\n")

    def stays(line: Column) -> Column:
        drop = F.lit(False)
        for p in prefixes:
            drop = drop | F.startswith(F.lower(F.trim(line)), F.lit(p.lower()))
        return ~drop & (F.trim(line) != "")

    return F.array_join(F.transform(F.filter(rest, stays), _trimmed), "\n")


def lexicon(x: Column, patterns: list[str], words: Column) -> dict[str, Column]:
    """Matches of a lexicon's patterns: count, presence, and matches a hundred words."""
    count = sum((F.regexp_count(x, F.lit(p)) for p in patterns[1:]), F.regexp_count(x, F.lit(patterns[0])))
    return {"count": count, "present": count > 0, "per_100_words": F.coalesce(F.try_divide(count * F.lit(100.0), words.cast("double")), F.lit(0.0))}


def tokens(x: Column, pattern: str = ASCII_WORD) -> Column:
    """Lower-cased tokens in order."""
    return F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.lower)


def vocabulary_overlap(x: Column, vocabulary: Column) -> tuple[Column, Column]:
    """How many words of a vocabulary a token array holds, and their share of it."""
    both = F.size(F.array_intersect(x, vocabulary))
    return both, F.try_divide(both.cast("double"), F.size(F.array_distinct(vocabulary)).cast("double"))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with its ``{name}`` places replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def options(keys: Column, labels: Column, permutation: Column) -> Column:
    """Lines ``key. label``; permutations 2 and 3 reverse the labels, 1 and 3 the keys."""
    labels = F.when(permutation.isin(2, 3), F.reverse(labels)).otherwise(labels)
    keys = F.when(permutation.isin(1, 3), F.reverse(keys)).otherwise(keys)
    return F.array_join(F.zip_with(keys, labels, lambda k, v: F.concat(k, F.lit(". "), v)), "\n")


def salted_hash(*parts: Column, digits: int = 16) -> Column:
    """The first hex digits of SHA-256 over the parts, joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, digits)


def content_hash(x: Column) -> Column:
    """A hash of normalised lower-cased text."""
    return F.substring(F.sha2(F.lower(squeezed(x)), 256), 1, 20)


def hash_shard(digest: Column, n: int) -> Column:
    """A 64-bit hex digest modulo n."""
    return F.pmod(F.conv(digest, 16, 10).cast("decimal(20,0)"), F.lit(n).cast("decimal(20,0)")).cast("int")


def hash_half(*parts: Column) -> Column:
    """``discovery`` or ``confirmation`` by the parity of the digest's first two hex digits."""
    first = F.conv(salted_hash(*parts, digits=2), 16, 10).cast("int")
    return F.when(first % 2 == 0, "discovery").otherwise("confirmation")


def _runs(words: Column, n: int) -> Column:
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.array_join(F.slice(words, k, F.lit(n)), " "))


def ngrams(words: Column, most: int) -> Column:
    """The distinct n-grams of 1 to ``most`` words, joined by spaces."""
    # The words are bound once: inside a lambda an expression is worked out for each element.
    return F.array_distinct(F.flatten(F.transform(F.array(words), lambda w: F.concat(*[_runs(w, n) for n in range(1, most + 1)]))))
