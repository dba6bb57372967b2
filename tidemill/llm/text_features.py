"""Character arrays of whole texts for numpy work inside tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

OTHER, LOWER, UPPER, DIGIT, BLANK, LINE, STOP, BANG, BAR, SYMBOL = range(10)


@lru_cache(maxsize=1)
def folded_letters() -> np.ndarray:
    """For each code point: the lower-cased letter, or 32 for what is no letter."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """For each code point its class."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isupper():
            table[c] = UPPER
        elif x.isalpha():
            table[c] = LOWER
        elif x.isdigit():
            table[c] = DIGIT
        elif x in "\n\r":
            table[c] = LINE
        elif x.isspace():
            table[c] = BLANK
        elif x in ".,;:'\"-()?":
            table[c] = STOP
        elif x == "!":
            table[c] = BANG
        elif x == "|":
            table[c] = BAR
        elif c < 128:
            table[c] = SYMBOL
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
