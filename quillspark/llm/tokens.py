"""Byte-level BPE ids of a ``tokenizers`` vocabulary file."""

from __future__ import annotations

import json
import os
import sys
from array import array
from collections.abc import Iterator

_encoders: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(ids: list[int]) -> bytes:
    """As little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def byte_letters() -> dict[str, int]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def ranked(spec: dict):
    """A ``tiktoken`` encoding equal to a vocabulary file, or None if its ids don't follow its merges."""
    import public_tokenizers
    import tiktoken

    model, letters = spec["model"], byte_letters()
    vocab, merges = model.get("vocab", {}), model.get("merges", [])
    pre = spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    ids = [vocab.get(a + b) for a, b in pairs]
    own = {x["content"] for x in spec.get("added_tokens", ())}
    if any(x is None for x in ids) or ids != sorted(ids) or any(c not in letters for w in vocab if w not in own for c in w):
        return None
    ranks = {bytes(letters[c] for c in w): k for w, k in vocab.items() if w not in own}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to those of the ``tokenizers`` library.

    Where the file's ids are its merge ranks, ``tiktoken`` makes the same ids four times as fast; texts with a
    special token's string or a run of white space too long for it, and files of other kinds, go to the library itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = tuple(x.content for x in self.library.get_added_tokens_decoder().values())
        self.ranks = ranked(json.loads(self.library.to_str()))

    def by_library(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def ids(self, text: str) -> list[int]:
        if self.ranks is None or any(x in text for x in self.special):
            return self.by_library(text)
        try:
            return self.ranks.encode_ordinary(text)
        except BaseException as e:
            # Its pattern runs out of stack on a very long run of white space, which it tells by a panic.
            if type(e).__name__ != "PanicException":
                raise
            return self.by_library(text)

    def encode(self, text: str) -> bytes:
        return packed(self.ids(text)) if text else b""


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def byte_table(keep) -> bytes:
    """For ``bytes.translate``: A-Z in lower case, bytes that ``keep`` refuses as spaces."""
    return bytes(c + 32 if 65 <= c <= 90 else c if keep(c) else 32 for c in range(256))


def byte_words(text: bytes, table: bytes, most: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``most`` bytes each, so that a long text is never held as one list."""
    text = text.translate(table)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + most)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end
