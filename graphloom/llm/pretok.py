"""Cutting texts into words for byte-level vocabularies, each distinct word handled once by a Python worker."""

from __future__ import annotations

import re
from collections.abc import Callable

CACHE = 500_000  #: distinct chunks, and words without a space before them, that a worker remembers

#: patterns that are known to always cut before a single space that follows no white space
CUT_AT_SPACES = frozenset([r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"])

_SPACES = re.compile(r" \s")
_MARKS = frozenset(".,;:!?|")


def cutter(pattern: str):
    """The compiled pattern, with white space as Unicode has it: the separators U+001C to U+001F are none."""
    import regex

    space = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return regex.compile(space)


class ChunkedEncoder:
    """Ids of whole texts from the ids of words.

    The patterns this serves always cut before a single space that follows no white space, so a text falls into chunks
    there, each a space and what follows it. Chunks are remembered by what follows the space, the first ``CACHE`` of them.
    Texts with white space right behind a space are cut by the pattern as a whole.
    """

    def __init__(self, pattern: str, fresh: Callable[[str], bytes], ready: dict[str, bytes] | None = None, cache: int = CACHE, mark: bytes | None = None):
        """``fresh`` gives a word's ids as bytes, never empty; ``ready`` the ids of words known beforehand. What holds ``mark`` is not remembered."""
        self.cut, self.fresh, self.cache, self.mark = cutter(pattern), fresh, cache, mark
        self.spaced = {w[1:]: x for w, x in (ready or {}).items() if w[0] == " " and len(w) > 1}
        self.bare = {w: x for w, x in (ready or {}).items() if w[0] != " " or len(w) == 1}
        self.known = len(ready or {})

    def _lasts(self, found: bytes) -> bool:
        return self.mark is None or self.mark not in found

    def word(self, word: str) -> bytes:
        held, key = (self.spaced, word[1:]) if word[0] == " " and len(word) > 1 else (self.bare, word)
        found = held.get(key)
        if found is None:
            found = self.fresh(word)
            if self._lasts(found) and len(held) < self.cache + self.known:
                held[key] = found
        return found

    def _chunk(self, rest: str) -> bytes:
        # letters alone are one word; the most usual marks behind them another
        if rest.isalpha():
            return self.word(" " + rest)
        if rest[-1] in _MARKS and rest[:-1].isalpha():
            found = (self.spaced.get(rest[:-1]) or self.word(" " + rest[:-1])) + self.word(rest[-1])
        else:
            found = b"".join(map(self.word, self.cut.findall(" " + rest)))
        if self._lasts(found) and len(self.spaced) < self.cache + self.known:
            self.spaced[rest] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text or text[-1] == " " or _SPACES.search(text):
            return b"".join(map(self.word, self.cut.findall(text)))
        first, *rest = text.split(" ")
        get, chunk = self.spaced.get, self._chunk
        return b"".join([*map(self.word, self.cut.findall(first)), *[get(c) or chunk(c) for c in rest]])
