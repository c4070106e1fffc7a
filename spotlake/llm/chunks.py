"""Splitting a text where no pre-token of the byte-level pattern crosses, so that the parts can be encoded once each."""

from __future__ import annotations

import re
from collections.abc import Callable
from sys import getsizeof

#: About what a dictionary takes for an entry besides the objects.
ENTRY_BYTES = 110
#: Texts by which a pattern is tried: it has to find the same pre-tokens in the parts as in the whole.
PROBES = ("one two", "a\nb c", "it's 12 x3, (y) z.", "don't\n\u00c9t\u00e9 \u65e5\u672c \U0001f389! #a", "A1 b2\n-c d_e f's 's")

_OTHER_SPACE = re.compile(r"[^\S \n]")


def split_chunks(text: str) -> list[str] | None:
    """Parts of text, each but the first led by a blank (left out) or by a newline (kept).

    None if a run of white space, or white space other than blank and newline, makes the split unsafe;
    such a text is encoded whole.
    """
    spaced = text.replace("\n", " \n")
    if "  " in spaced or " \n " in spaced or _OTHER_SPACE.search(text):
        return None
    return spaced.split(" ")


class PartCache(dict):
    """part -> encode(part), computed on first use; emptied when its parts and values hold more than `most` bytes.

    A part of over `longest` characters is worked out each time and not kept.
    """

    def __init__(self, encode: Callable[[str], object], most: int = 96 << 20, longest: int = 64):
        super().__init__()
        self.encode, self.most, self.longest, self.held = encode, most, longest, 0

    def __missing__(self, part: str):
        value = self.encode(part)
        if len(part) <= self.longest:
            self.held += getsizeof(part) + getsizeof(value) + ENTRY_BYTES
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[part] = value
        return value


def parts_alone(find: Callable[[str], list[str]]) -> bool:
    """Whether pre-tokens end where split_chunks() cuts, as tried on PROBES."""
    led = lambda chunks: [c if not i or c.startswith("\n") else " " + c for i, c in enumerate(chunks)]
    return all(find(text) == [t for part in led(split_chunks(text) or [text]) for t in find(part)] for text in PROBES)


class ChunkEncoder:
    """ids of a text as bytes, from a function that encodes a string; parts seen before come from a cache."""

    def __init__(self, encode: Callable[[str], bytes], whole: re.Pattern | None = None):
        """whole: a text in which this is found is encoded in one go (special strings)."""
        self.encode, self.whole = encode, whole
        self.parts = PartCache(lambda part: encode(part if part.startswith("\n") else " " + part))

    def __call__(self, text: str) -> bytes:
        chunks = None if self.whole is not None and self.whole.search(text) else split_chunks(text)
        if chunks is None:
            return self.encode(text)
        chunks_led = chunks[1:]
        return (self.encode(chunks[0]) if chunks[0] else b"") + b"".join(map(self.parts.__getitem__, chunks_led))
