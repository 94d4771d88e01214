"""Runs of letters of many texts, as arrays of code points."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

# Script of letters by range of code points (fixed values); others share script 0.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x2FA1F),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: whether it is a letter or a mark on one, its lower case, its script."""
    letter, lower = np.zeros(sys.maxunicode + 1, bool), np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for point in range(sys.maxunicode + 1):
        sign = chr(point)
        if unicodedata.category(sign)[0] in "LM":
            letter[point] = True
            small = sign.lower()
            if len(small) == 1:
                lower[point] = ord(small)
    script = np.zeros(sys.maxunicode + 1, np.uint8)
    for name, first, last in SCRIPTS:
        script[first:last + 1] = SCRIPT_NAMES.index(name)
    return letter, lower, script


@lru_cache(1)
def base_letters() -> np.ndarray:
    """Of every code point: whether it is a letter itself."""
    return np.array([unicodedata.category(chr(point))[0] == "L" for point in range(sys.maxunicode + 1)])


class LetterRuns:
    """Maximal runs of letters and marks that hold a letter: their first and last places, and where texts begin."""

    def __init__(self, texts: list[str]):
        letter, lower, _ = tables()
        self.edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
        points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.zeros(0, np.uint32)
        solid = letter[points]
        before = np.concatenate([[False], solid[:-1]])
        after = np.concatenate([solid[1:], [False]])
        self.starts, self.ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        sums = np.concatenate([[0], np.cumsum(base_letters()[points])])
        held = sums[self.ends] > sums[self.starts]
        if not held.all():  # marks alone aren't a word
            for a, b in zip(self.starts[~held].tolist(), self.ends[~held].tolist()):
                solid[a:b] = False
            self.starts, self.ends = self.starts[held], self.ends[held]
        # Letters only, a zero at each run's edge is put in by ``neighbours``.
        self.letters = lower[points[solid]]
        self.sizes = self.ends - self.starts
        self.first_letter = np.cumsum(self.sizes) - self.sizes
        #: Index of the first run of each text; one more entry than texts.
        self.first = np.searchsorted(self.starts, self.edges)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Letters before and after each letter in its run, 0 at the run's edge."""
        left, right = np.zeros_like(self.letters), np.zeros_like(self.letters)
        left[1:], right[:-1] = self.letters[:-1], self.letters[1:]
        left[self.first_letter] = 0
        right[self.first_letter + self.sizes - 1] = 0
        return left, right

    def of_text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
