"""The stance that a text's last lines state, found conservatively, as column expressions.

The lines are read as words and marks. An option is named where its label's words stand, unless they end a longer
option's label there, or where its key stands in a place that only answers have: after a leading word, at a line's
beginning as an item's number, or before a verdict. What is named last counts, if it is one option.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import last_lines

#: Lines at the end that are read.
TAIL = 5
#: Words that lead to an option's key, marks between both, marks after a key, verdicts.
LEADS = ("stance", "answer", "position", "choice", "option")
BETWEEN = (":", "=", "-")
AFTER = (".", ")")
VERDICTS = ("agree", "disagree", "strongly agree", "strongly disagree")
_LINE = "\n"


def tokens(x: Column) -> Column:
    """Lower-cased words, single marks, and line ends; stars that open a word are dropped."""
    found = F.regexp_extract_all(F.lower(x), F.lit(r"\n|(?U:\**\w+)|\*+|(?U:[^\w\s*])"), F.lit(0))
    return F.transform(found, lambda t: F.when(F.length(F.translate(t, "*", "")) > 0, F.translate(t, "*", "")).otherwise(t))


def _stand(words: Column, at: Column, phrase: str) -> Column:
    """Whether a phrase's words stand from a place on."""
    same = [F.coalesce(F.get(words, at + k) == w, F.lit(False)) for k, w in enumerate(phrase.lower().split())]
    return reduce(lambda a, b: a & b, same)


def _any(words: Column, at: Column, of: Sequence[str]) -> Column:
    return F.coalesce(F.get(words, at).isin(*of), F.lit(False))


def named_as_label(words: Column, at: Column, label: str, labels: Sequence[str]) -> Column:
    out = _stand(words, at, label)
    for longer in labels:
        head = longer.lower().split()[: -len(label.split())]
        # A line may end between the words of the longer label.
        if head and longer.lower().split()[len(head) :] == label.lower().split():
            out &= ~(_stand(words, at - len(head), " ".join(head)) | ((F.get(words, at - 1) == _LINE) & _stand(words, at - 1 - len(head), " ".join(head))))
    return F.coalesce(out, F.lit(False))


def key_place(words: Column, at: Column, key: str) -> Column:
    """Where the naming of a key at ``at`` begins: at the key, or at the word that leads to it."""
    begins = (at == 0) | _any(words, at - 1, [_LINE])
    ends = F.get(words, at + 1).isNull() | _any(words, at + 1, [*AFTER, _LINE])
    judged = _any(words, at + 1, AFTER) & reduce(lambda a, b: a | b, [_stand(words, at + 2, v) for v in VERDICTS])
    led = F.when(_any(words, at - 1, LEADS), at - 1).when(_any(words, at - 1, BETWEEN) & _any(words, at - 2, LEADS), at - 2)
    return F.when(F.get(words, at) == key.lower(), F.when((begins & ends) | judged, at).otherwise(led))


def explicit_stance(x: Column, keys: Sequence[str], labels: Sequence[str]) -> Column:
    """Index of the option that a text names last; null without one, or if several are named at that place. Keys are single words."""
    tail = F.array_join(last_lines(F.regexp_replace(x, r"\r\n?", "\n"), TAIL), _LINE)

    def last_place(words: Column, key: str, label: str) -> Column:
        return F.array_max(F.transform(words, lambda w, i: F.greatest(F.when(named_as_label(words, i, label, labels), i), key_place(words, i, key))))

    def decided(words: Column) -> Column:
        return F.transform(F.array(F.array(*[last_place(words, k, v) for k, v in zip(keys, labels, strict=True)])), winner)[0]

    def winner(places: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda k: F.get(places, k) == F.array_max(places))
        return F.when(F.size(at) == 1, at[0])

    return F.transform(F.array(tokens(tail)), decided)[0]
