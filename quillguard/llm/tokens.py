"""Counting tokens of a public byte-level tokenizer, and plain words."""

from __future__ import annotations

import base64
import re
import unicodedata
from functools import lru_cache

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer of the vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 150_000  # pieces of text whose count is remembered in a worker


class _Counts(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


class Counter:
    """Number of tokens of a text.

    The tokenizer never merges across a single space between two other characters, so the count of a text
    is the sum over its pieces " word", which repeat and are remembered.
    """

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.counts = _Counts(self.encode)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " in text or text[0].isspace() or text[-1].isspace() or " \n" in text or "\n " in text or "\t" in text or "\r" in text or " " in text:
            return len(self.encode(text))
        first, *rest = text.split(" ")
        get = self.counts.__getitem__
        return get(first) + sum(map(get, [" " + x for x in rest]))


@lru_cache(2)
def counter(vocabulary: bytes) -> Counter:
    """The counter of a vocabulary (the bytes of its file), once in each worker."""
    return Counter(vocabulary)


_WORD = re.compile(r"[^\W_]+")
_DROP = dict.fromkeys([*range(0x0300, 0x0370), *range(0x064B, 0x0660), 0x0670, 0x0640])


def words(text: str) -> list[str]:
    """Words in lower case without accents, marks, punctuation and white space."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_DROP)
    return _WORD.findall(text.casefold())
