"""Lookup tables of character properties by code point, built once per process from Unicode data."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

LIMIT = 0x30000
LETTER, DIGIT, MARK, SPACE, LOWER, UPPER, HAN, THAI, BREAK, KANA = 1, 2, 4, 8, 16, 32, 64, 128, 256, 512


@lru_cache(maxsize=1)
def properties() -> np.ndarray:
    """uint16 flags per code point."""
    flags = np.zeros(LIMIT + 1, np.uint16)
    for first, last in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFAFF), (0x20000, LIMIT)):
        flags[first:last] = LETTER | HAN
    flags[0xAC00:0xD7A4] = LETTER
    for first, last in ((0, 0x3400), (0xA000, 0xAC00), (0xFB00, 0x20000)):
        for cp in range(first, last):
            c = chr(cp)
            kind = unicodedata.category(c)
            f = LETTER if kind[0] == "L" else DIGIT if kind[0] == "N" else MARK if kind[0] == "M" else 0
            if c.isspace():
                f |= SPACE
            if kind == "Ll":
                f |= LOWER
            elif kind in ("Lu", "Lt"):
                f |= UPPER
            flags[cp] = f
    flags[0xE00:0xE80] |= THAI
    flags[0x3040:0x3100] |= KANA
    flags[0x31F0:0x3200] |= KANA
    flags[[0x3005, 0x3007]] |= HAN | LETTER
    for c in "\n\r\x0b\x0c\x1c\x1d\x1e\x85  ":
        flags[ord(c)] |= BREAK | SPACE
    return flags


def look(points: np.ndarray) -> np.ndarray:
    return properties()[np.minimum(points, LIMIT)]
