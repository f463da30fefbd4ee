"""Operator 3, token counts: edit-aware counting on segment trees of pre-tokens.

A document's pre-tokens stand in leaves: runs of whole pre-tokens of about ``leaf_chars`` characters, each ending
before a single space between two other characters, where the pre-tokeniser always breaks. A segment tree over
the leaves sums characters and tokens. An edit finds its leaves by descending the character sums, takes in a
neighbour whose boundary it comes near enough to unsettle, encodes that region alone, and updates the sums on the
paths to the root; the document's count is the root's. So counts after edits equal those of encoding the edited
text as a whole, at the cost of the regions.

Defined cases: null or empty text has no tokens and takes insertions at 0; edits may touch or repeat, in order of
their start, and must lie in the text and not overlap; repeated rows are counted each; an empty table gives no
rows; other columns are ignored. A text without single spaces between other characters (unspaced scripts) is one
leaf, which each edit encodes again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.tokens import default_tokenizer, encoder

Edit = tuple[int, int, str]
_BREAK = re.compile(r"(?<=\S) (?=\S)")


def leaves_of(text: str, leaf_chars: int) -> list[str]:
    out, at = [], 0
    while at < len(text):
        found = _BREAK.search(text, at + leaf_chars)
        end = found.start() if found else len(text)
        out.append(text[at:end])
        at = end
    return out


class CountTree:
    """Leaves of a text and sums of their characters and tokens; ``encoded`` counts leaves that were encoded."""

    def __init__(self, text: str, count: Callable[[str], int], leaf_chars: int = 256) -> None:
        self.count, self.leaf_chars, self.encoded = count, leaf_chars, 0
        self.leaves = leaves_of(text, leaf_chars)
        self.encoded += len(self.leaves)
        self._sum([count(x) for x in self.leaves])

    def _sum(self, tokens: list[int]) -> None:
        self.size = 1 << max(0, len(tokens) - 1).bit_length()
        pad = [0] * (self.size - len(tokens))
        self.chars = [0] * self.size + [len(x) for x in self.leaves] + pad
        self.tokens = [0] * self.size + tokens + pad
        for k in range(self.size - 1, 0, -1):
            self._add(k)

    def _add(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character place, and where it starts; at the end of the text, the last leaf."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if at >= start + self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from start to end."""
        if not 0 <= start <= end <= self.chars[1]:
            raise ValueError(f"no place {start}-{end} in a text of {self.chars[1]} characters")
        if not self.leaves:
            self.leaves = [""]
            self._sum([0])
        # A leaf's first boundary rests on the character before it, its space and the one after.
        first, begins = self.find(start)
        while first and start < begins + 2:
            first -= 1
            begins -= len(self.leaves[first])
        last, at = self.find(end)
        at += len(self.leaves[last])
        while last + 1 < len(self.leaves) and end >= at:
            last += 1
            at += len(self.leaves[last])
        old = "".join(self.leaves[first : last + 1])
        region, room = leaves_of(old[: start - begins] + new + old[end - begins :], self.leaf_chars), last + 1 - first
        # The number of leaves stays, with empty ones or a longer last one, unless that would grow far too long.
        if len(region) < room:
            region += [""] * (room - len(region))
        elif len(region) > room and len(rest := "".join(region[room - 1 :])) <= 4 * self.leaf_chars:
            region[room - 1 :] = [rest]
        tokens = [self.count(x) for x in region]
        self.encoded += len(region)
        if len(region) == room:
            self.leaves[first : last + 1] = region
            for k, (x, n) in enumerate(zip(region, tokens, strict=True), self.size + first):
                self.chars[k], self.tokens[k] = len(x), n
            lo, hi = (self.size + first) // 2, (self.size + last) // 2
            while lo:
                for k in range(lo, hi + 1):
                    self._add(k)
                lo, hi = lo // 2, hi // 2
        else:  # another number of leaves: new sums, but no other leaf is encoded
            counts = self.tokens[self.size : self.size + len(self.leaves)]
            self.leaves[first : last + 1], counts[first : last + 1] = region, tokens
            self._sum(counts)


def apply_edits(tree: CountTree, edits: Iterable[Edit]) -> int:
    """Apply edits whose places are those of the text before any of them; their number."""
    n = shift = 0
    for start, end, new in sorted(edits, key=lambda e: e[:2]):
        tree.edit(start + shift, end + shift, new)
        shift += len(new) - (end - start)
        n += 1
    return n


#: A mail address where a name can begin, and one right at a place. Names are taken whole, so a long word is read once.
_MAIL = re.compile(r"(?<![\w.+-])[\w.+-]++@[\w-]++\.[\w.-]+")
_MAIL_HERE = re.compile(r"[\w.+-]++@[\w-]++\.[\w.-]+")
_DIGITS = re.compile(r"\d{6,}")


def addresses(text: str) -> Iterator[re.Match]:
    """Mail addresses from left to right, in time linear in the text."""
    found = _MAIL.search(text) if "@" in text else None
    while found:
        yield found
        # The next one may begin within a word that this one ends in.
        found = _MAIL_HERE.match(text, found.end()) or _MAIL.search(text, found.end())


def redactions(text: str) -> list[Edit]:
    """The query's edits: mail addresses and long numbers by a placeholder."""
    out = [(m.start(), m.end(), "<mail>") for m in addresses(text)]
    numbers, k, n = [], 0, len(out)
    for m in _DIGITS.finditer(text):  # both lists are in order
        while k < n and out[k][1] <= m.start():
            k += 1
        if k == n or out[k][0] >= m.end():
            numbers.append((m.start(), m.end(), "<number>"))
    return out + numbers


def count_edited(docs: DataFrame, edits_of: Callable[[str], list[Edit]] = redactions, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = 256, tokenizer: str | None = None) -> DataFrame:
    """Per row: id, tokens_before, tokens_after, n_edits, n_leaves and, of these, how many edits made encode again."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                tree = CountTree(text, lambda x: len(own.ids(x)) if x else 0, leaf_chars)
                before, leaves = tree.total, len(tree.leaves)
                n = apply_edits(tree, edits_of(text))
                out.append((doc, before, tree.total, n, leaves, tree.encoded - leaves))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 6, names=["doc_id", "tokens_before", "tokens_after", "n_edits", "n_leaves", "n_encoded_again"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, tokens_before long, tokens_after long, n_edits long, n_leaves long, n_encoded_again long")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """The query: counts of all documents before and after redaction."""
    return count_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
