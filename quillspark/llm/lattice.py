"""Unigram lattices of words over a fixed piece vocabulary, many words at a time in numpy.

Every piece that a word holds is an edge from where it begins to where it ends, found by walking a trie of the
vocabulary from all places at once. The forward recursion adds, in log space, the weights of all segmentations up to
each place; with the backward one it gives each piece's expected number of uses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: A word's first character in a lattice; no code point, so that a text's own marks can't be taken for it.
BOUNDARY = 0x110000
#: Words of more characters go through the recursion one by one, a window of places at a time.
LONG = 1500
_WINDOW = 1 << 18
_BITS = 21


@dataclass
class Edges:
    """Edges sorted by end and size. ``cuts``: where a run of edges of one end and size begins; ``piece`` below 0: a spelled character."""

    start: np.ndarray
    size: np.ndarray
    piece: np.ndarray
    cuts: np.ndarray


class Vocabulary:
    """Pieces as a trie. ``pieces[k]`` is piece k's text (``mark`` for the word's beginning), or None for one that no text matches.

    Characters that are no piece by themselves are spelled with the pieces of their UTF-8 bytes, or with ``unknown``.
    """

    def __init__(self, pieces: list[str | None], bytes_: dict[int, int], unknown: int, mark: str = "▁") -> None:
        self.size, self.bytes_, self.unknown = len(pieces), bytes_, unknown
        self.longest = max((len(p) for p in pieces if p), default=1)
        children: dict[tuple[int, int], int] = {}
        piece_of = [-1]
        for k, p in enumerate(pieces):
            node = 0
            for c in p or "":
                key = (node, BOUNDARY if c == mark else ord(c))
                node = children.setdefault(key, len(piece_of))
                if node == len(piece_of):
                    piece_of.append(-1)
            if p:
                piece_of[node] = k
        order = sorted(children)
        self.keys = np.array([a << _BITS | c for a, c in order], np.int64)
        self.child = np.array([children[x] for x in order], np.int64)
        self.piece_of = np.array(piece_of, np.int64)

    def spelling(self, c: int) -> list[int]:
        """Pieces of a character that is none."""
        text = "▁" if c == BOUNDARY else chr(c)
        return [self.bytes_[b] for b in text.encode("utf-8", "surrogatepass")] if self.bytes_ else [self.unknown]

    def step(self, node: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The trie's nodes after one more character, -1 where there is none."""
        key = node << _BITS | point
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else np.zeros(len(key), int)
        return np.where(self.keys[at] == key, self.child[at], -1) if len(self.keys) else np.full(len(key), -1)

    def edges(self, points: np.ndarray, room: np.ndarray, offset: np.ndarray) -> Edges:
        """All edges over ``points``. ``room``: characters left in the word from each place; ``offset``: characters before it.

        Starts are places; the lattice's nodes are left to the caller.
        """
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        starts, sizes, found = [], [], []
        for n in range(1, self.longest + 1):
            node = self.step(node, points[at + n - 1])
            piece = np.where(node >= 0, self.piece_of[node], -1)
            if n == 1:
                lone = piece < 0
                starts.append(at[lone])
                found.append(-1 - points[at[lone]])
                sizes.append(np.ones(int(lone.sum()), np.int64))
            hit = piece >= 0
            starts.append(at[hit])
            found.append(piece[hit])
            sizes.append(np.full(int(hit.sum()), n, np.int64))
            alive = (node >= 0) & (room[at] > n)
            at, node = at[alive], node[alive]
            if not len(at):
                break
        start, size, piece = (np.concatenate(x) for x in (starts, sizes, found))
        key = (offset[start] + size) * (self.longest + 1) + size
        if len(key) and key.max() < 1 << 16:
            key = key.astype(np.uint16)
        order = np.argsort(key, kind="stable")
        key = key[order]
        return Edges(start[order], size[order], piece[order], np.flatnonzero(np.diff(key.astype(np.int64), prepend=-1, append=-1)))

    def weights(self, edges: Edges, scores: np.ndarray) -> np.ndarray:
        """The edges' log weights."""
        out = scores[np.maximum(edges.piece, 0)]
        spelled = np.flatnonzero(edges.piece < 0)
        if len(spelled):
            points, back = np.unique(-1 - edges.piece[spelled], return_inverse=True)
            out[spelled] = np.array([scores[self.spelling(int(c))].sum() for c in points])[back]
        return out


def batches(words: list[str], most: int = 1 << 17) -> Iterator[list[int]]:
    """Numbers of words, of like lengths, ``most`` characters or so at a time; long ones alone."""
    order = np.argsort([len(w) for w in words], kind="stable")
    now: list[int] = []
    size = 0
    for k in order:
        n = len(words[k]) + 1
        if now and (size + n > most or n > LONG):
            yield now
            now, size = [], 0
        now.append(int(k))
        size += n
    if now:
        yield now


class Batch:
    """The lattices of some words: places, nodes (a word of n places has n + 1) and edges."""

    def __init__(self, words: list[str], vocabulary: Vocabulary, marked: bool = True) -> None:
        text = "".join(f" {w}" for w in words) if marked else "".join(words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        n = np.array([len(w) + marked for w in words])
        first = np.cumsum(n) - n
        if marked:
            points[first] = BOUNDARY
        word = np.repeat(np.arange(len(words)), n)
        offset = np.arange(len(points)) - first[word]
        self.edges = vocabulary.edges(points, n[word] - offset, offset)
        self.begin = first + np.arange(len(words))
        self.finish = self.begin + n
        self.nodes = len(points) + len(words)
        self.word = word[self.edges.start]
        self.a = self.edges.start + self.word
        self.b = self.a + self.edges.size

    def forward(self, w: np.ndarray) -> np.ndarray:
        alpha = np.full(self.nodes, -np.inf)
        alpha[self.begin] = 0.0
        for i, j in zip(self.edges.cuts, self.edges.cuts[1:], strict=False):
            b = self.b[i:j]
            alpha[b] = np.logaddexp(alpha[b], alpha[self.a[i:j]] + w[i:j])
        return alpha

    def backward(self, w: np.ndarray) -> np.ndarray:
        beta = np.full(self.nodes, -np.inf)
        beta[self.finish] = 0.0
        cuts = self.edges.cuts
        for k in range(len(cuts) - 2, -1, -1):
            i, j = cuts[k], cuts[k + 1]
            a = self.a[i:j]
            beta[a] = np.logaddexp(beta[a], beta[self.b[i:j]] + w[i:j])
        return beta


def log_likelihoods(words: list[str], vocabulary: Vocabulary, scores: np.ndarray) -> np.ndarray:
    """Natural log probability of each word, over all its segmentations."""
    out = np.empty(len(words))
    for own in batches(words):
        if len(own) == 1 and len(words[own[0]]) >= LONG:
            out[own] = long_likelihood(words[own[0]], vocabulary, scores)
            continue
        batch = Batch([words[k] for k in own], vocabulary)
        out[own] = batch.forward(vocabulary.weights(batch.edges, scores))[batch.finish]
    return out


def long_likelihood(word: str, vocabulary: Vocabulary, scores: np.ndarray) -> float:
    """The same for one word of any length: the last nodes' sums go from window to window."""
    total = len(word) + 1
    alpha = np.zeros(1)
    for lo in range(0, total, _WINDOW):
        hi = min(total, lo + _WINDOW)
        text = word[max(0, lo - 1) : min(len(word), hi - 1 + vocabulary.longest)]
        points = np.frombuffer(((" " if lo == 0 else "") + text).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        if lo == 0:
            points[0] = BOUNDARY
        places = np.arange(len(points))
        edges = vocabulary.edges(points, len(points) - places, places)
        own = edges.start < hi - lo
        weight = vocabulary.weights(edges, scores)[own]
        start, end = edges.start[own], (edges.start + edges.size)[own]
        sums = [-np.inf] * (len(points) + 1)
        sums[: len(alpha)] = alpha.tolist()
        order = np.argsort(start, kind="stable")
        for a, b, w in zip(start[order].tolist(), end[order].tolist(), weight[order].tolist(), strict=True):
            x, y = sums[a] + w, sums[b]
            if x > y:
                x, y = y, x
            sums[b] = y + np.log1p(np.exp(x - y)) if x > -np.inf else y
        alpha = np.array(sums[hi - lo :])
    return float(alpha[0])


def expected_uses(words: list[str], counts: np.ndarray, vocabulary: Vocabulary, scores: np.ndarray) -> np.ndarray:
    """How often each piece is used in all segmentations of the words, by their probability and the words' counts.

    Words of over :data:`LONG` characters are learned from in parts of so many.
    """
    out = np.zeros(vocabulary.size)
    short = [k for k, w in enumerate(words) if len(w) < LONG]
    for own in batches([words[k] for k in short]):
        _uses(out, [words[short[k]] for k in own], counts[[short[k] for k in own]], vocabulary, scores, True)
    for k, w in enumerate(words):
        if len(w) >= LONG:
            _uses(out, [w[: LONG - 1]], counts[[k]], vocabulary, scores, True)
            rest = [w[i : i + LONG] for i in range(LONG - 1, len(w), LONG)]
            for i in range(0, len(rest), 64):
                _uses(out, rest[i : i + 64], np.repeat(counts[k], len(rest[i : i + 64])), vocabulary, scores, False)
    return out


def _uses(out: np.ndarray, words: list[str], counts: np.ndarray, vocabulary: Vocabulary, scores: np.ndarray, marked: bool) -> None:
    batch = Batch(words, vocabulary, marked)
    w = vocabulary.weights(batch.edges, scores)
    alpha, beta = batch.forward(w), batch.backward(w)
    share = np.exp(alpha[batch.a] + w + beta[batch.b] - alpha[batch.finish][batch.word]) * counts[batch.word]
    piece = batch.edges.piece
    known = piece >= 0
    out += np.bincount(piece[known], share[known], len(out))
    for c, n in zip(-1 - piece[~known], share[~known], strict=True):
        np.add.at(out, vocabulary.spelling(int(c)), n)
