"""Public vocabularies, the split of a text into parts, and a bounded memory of parts seen."""

from __future__ import annotations

import base64
import gc
import re
from collections.abc import Callable, Iterator
from functools import cache

import public_tokenizers
import regex

SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
EXACT = regex.compile(public_tokenizers.PATTERN)


@cache
def _odd_characters() -> frozenset[str]:
    """Where the standard library's classes differ from Unicode's L, N and white space."""
    every = map(chr, range(0x110000))
    return frozenset(c for c in every if "\x1c" <= c <= "\x1f" or c.isalnum() and not c.isalpha() and not c.isdecimal())


@cache
def _common() -> re.Pattern:
    """The same split in the standard library's classes, for texts without odd characters. Twice as fast."""
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w{SPACES}]|_)+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
    )


def pieces(text: str) -> list[str]:
    """The pieces of a text that are encoded each by itself."""
    return _common().findall(text) if _odd_characters().isdisjoint(text) else EXACT.findall(text)


OTHER_SPACE = re.compile(r"[^\S \n]")
PAIRS = ("  ", " \n", "\n ", "\n\n")


def loose(text: str) -> bool:
    """Whether the text has other white space than single blanks and line feeds. If not, each of them begins a piece."""
    return any(pair in text for pair in PAIRS) or OTHER_SPACE.search(text) is not None


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def slices(texts: list[str], most_chars: int = 2_000_000) -> Iterator[list[str]]:
    """The texts in order, in runs that end once they hold so many characters."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= most_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


class Numbered(dict):
    """Gives each key that it is asked for the next whole number."""

    def __init__(self):
        self.order: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self.order)
        self.order.append(key)
        return number


class Remembered:
    """Parts of texts and what was made of each. Beyond ``most`` parts it forgets all and makes them anew."""

    def __init__(self, make: Callable[[list[str]], list], most: int = 900_000):
        self.make, self.most = make, most
        self.numbers, self.values = Numbered(), []

    def forget(self) -> None:
        self.numbers, self.values = Numbered(), []

    def of(self, texts: list[list[str]]) -> Iterator[list]:
        """The values of the parts of each text."""
        if len(self.values) > self.most:
            self.forget()
        # Very many objects are made here and none refers back to another, so the
        # collector's passes over the whole memory would find nothing.
        collecting = gc.isenabled()
        gc.disable()
        try:
            number = self.numbers.__getitem__
            coded = [list(map(number, parts)) for parts in texts]
            if new := self.numbers.order[len(self.values) :]:
                self.values += self.make(new)
        finally:
            if collecting:
                gc.enable()
        value = self.values.__getitem__
        for codes in coded:
            yield list(map(value, codes))
