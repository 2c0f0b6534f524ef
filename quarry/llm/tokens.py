"""Encoding with a library tokenizer, pre-token by pre-token, with a bounded cache.

Real text repeats its pre-tokens, so most of a text's ids come from the cache; the tokenizer itself encodes each
pre-token that is new to the worker. That gives the same ids as encoding the whole text wherever the split and the
normalisation of a pre-token don't depend on its surroundings; texts for which this isn't certain (it isn't all plain
Latin) go through the tokenizer whole. So do texts that hold the content of one of the tokenizer's added tokens, such
as <|endoftext|>: as by the library's default, each is one id.

Edge cases: a null text counts as empty and has no ids; texts are taken whole, and long pre-tokens aren't cached. Tables
and their columns don't matter here, as all work is on one text.
"""

from __future__ import annotations

import array
import json
import os
from functools import lru_cache
from itertools import compress

from tokenizers import Tokenizer

from .split import PLAIN, splitter

CACHE_ENTRIES = 200_000
CACHED_CHARS = 40


def pattern_of(path: str) -> str:
    """The pattern by which a tokenizer file splits texts."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["pre_tokenizer"]
    for step in found.get("pretokenizers", [found]):
        if step["type"] == "Split" and "Regex" in step["pattern"]:
            return step["pattern"]["Regex"]
    raise ValueError("the tokenizer has no pattern of its own")


def byte_alphabet() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones as they are, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(own)))
    return [out[b] for b in range(256)]


class Encoder:
    """Encodes by a byte-level BPE tokenizer file, given the pattern by which it splits and whether it lower-cases.

    added: whether added tokens in a text get their own ids; else their characters are split like any others.
    """

    def __init__(self, path: str, pattern: str, lower: bool, cache_entries: int = CACHE_ENTRIES, added: bool = False) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized for t in tokens):
            raise ValueError("an added token is matched in the normalised text")
        self.added = [t.content for t in tokens] if added else []
        if "ByteLevel" not in json.dumps(json.loads(self.tokenizer.to_str())["pre_tokenizer"]):
            raise ValueError("not a byte-level tokenizer")
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.find, self.lower, self.cache_entries = splitter(pattern), lower, cache_entries
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was met before the cache was last full

    def _piece(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            own = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.alphabet)
            ids = array.array("I", [t.id for t in self.model.tokenize(own)]).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self.cache) >= self.cache_entries:
                self.cache, self.older = {}, self.cache
            self.cache[piece] = ids
        return ids

    def one(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; a null text counts as empty."""
        if not text:
            return b""
        if not PLAIN(text) or any(x in text for x in self.added):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        pieces = self.find(text.lower() if self.lower else text)
        found = list(map(self.cache.get, pieces))
        if None in found:
            for i in compress(range(len(found)), [x is None for x in found]):
                found[i] = self.cache.get(pieces[i]) or self._piece(pieces[i])
        return b"".join(found)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self.one(x) for x in texts]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, lower: bool, cache_entries: int = CACHE_ENTRIES) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(path, pattern, lower, cache_entries, added=True)
