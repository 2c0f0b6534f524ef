"""Splitting texts by a tokenizer's pattern.

Unicode properties are slow to test. For texts of Latin characters alone, the bulk of most corpora, the pattern's
classes are spelled out as ranges, which the standard library's engine matches two to three times as fast; all other
texts go by the pattern itself.

What a letter or a number is depends on an engine's version of Unicode: here it is what tiktoken's engine takes for one.
The regex library also counts code points that aren't assigned; a text that holds any on which the two differ goes by
the pattern with all classes spelled out.

Edge cases: a null text isn't split (callers take it as empty), an empty one has no matches, long ones are split whole;
repeated texts and columns of tables don't matter here, as all work is on one text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import regex
import tiktoken

#: The last character of the blocks Basic Latin to Latin Extended-B.
LAST = 0x24F
PLAIN = regex.compile(f"[\0-{chr(LAST)}]*+").fullmatch


ESCAPE = re.compile(r"\\p\{\w+\}|\\s")


@lru_cache
def members(escape: str) -> np.ndarray:
    """For each code point whether tiktoken's engine matches it by an escape: what it leaves of all characters in a row."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    engine = tiktoken.Encoding("bytes", pat_str=escape, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    found = np.zeros(0x110000, dtype=bool)
    found[np.frombuffer(bytes(engine.encode_ordinary(every)).decode().encode("utf-32-le"), dtype="<u4")] = True
    return found


@lru_cache
def departures(escapes: tuple[str, ...]) -> np.ndarray:
    """For each code point whether the regex library differs on any of the escapes."""
    found = np.zeros(0x110000, dtype=bool)
    for escape in escapes:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        own = np.zeros(0x110000, dtype=bool)
        own[np.frombuffer("".join(regex.findall(f"{escape}+", every)).encode("utf-32-le"), dtype="<u4")] = True
        found |= own != members(escape)
    return found


def departs(text: str, escapes: tuple[str, ...]) -> bool:
    """Whether a text holds a code point on which the engines differ."""
    return bool(departures(escapes)[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")].any())


def ranges(own: Iterable[int]) -> str:
    """Code points as ranges of a class."""
    at = np.array(sorted(own))
    new = np.flatnonzero(np.diff(at) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(at[np.r_[0, new + 1]], at[np.r_[new, len(at) - 1]], strict=True)) if len(at) else ""


@lru_cache
def plain_ranges(escape: str) -> str:
    """The plain characters that an escape matches: engines agree on them."""
    return ranges(c for c in range(LAST + 1) if regex.match(escape, chr(c)))


@lru_cache
def all_ranges(escape: str) -> str:
    return ranges(np.flatnonzero(members(escape)))


def spelled_out(pattern: str, of: Callable[[str], str] = plain_ranges) -> str:
    r"""pattern with \p{..} and \s as ranges (and \S as its complement, outside of classes)."""
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern):
        if ESCAPE.fullmatch(part):
            out.append(of(part) if inside else f"[{of(part)}]")
        elif part == r"\S" and not inside:
            out.append(f"[^{of(chr(92) + 's')}]")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return "".join(out)


def hoisted(pattern: str) -> str:
    """pattern with its alternatives that begin with a class first, where no alternative before them can match at a character of the class.

    That changes no match, and spares most characters the tests of the literal alternatives.
    """
    parts = [p for p in regex.findall(r"(?:\\.|\[(?:\\.|[^\]])*\]|\((?:\\.|[^()])*\)|[^|])+", pattern)]
    first, rest = [], []
    for part in parts:
        own = regex.match(r"\[(?:\\.|[^\]])*\]", part)
        begins = [x[1] if x[0] == "\\" else x[0] for x in rest]
        plain = all(regex.match(r"\\?[^\w\s\[\](){}?*+.^$]|\w", x) for x in rest)  # a literal character
        (first if own and plain and not any(regex.match(own[0], c) for c in begins) else rest).append(part)
    return "|".join(first + rest)


@lru_cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function from a text to the list of all matches."""
    whole, plain = regex.compile(pattern).findall, re.compile(spelled_out(hoisted(pattern))).findall
    escapes = tuple(dict.fromkeys(ESCAPE.findall(pattern)))

    def split(text: str) -> list[str]:
        if PLAIN(text):
            return plain(text)
        return exact()(text) if departs(text, escapes) else whole(text)

    @lru_cache
    def exact():
        return re.compile(spelled_out(pattern, all_ranges)).findall

    return split
