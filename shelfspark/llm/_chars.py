"""Code points of Arrow text columns and their classes."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE, UNASSIGNED = 0, 1, 2, 3, 4
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


@cache
def classes() -> np.ndarray:
    """The class of every code point: letter (L*), number (N*), white space, unassigned in Python's Unicode, or other.

    A tokenizer may follow a later Unicode, so what is unassigned here says nothing about what it is there.
    """
    kind = {"L": LETTER, "N": NUMBER}
    of = {c: UNASSIGNED if c == "Cn" else kind.get(c[0], OTHER) for c in {unicodedata.category(chr(c)) for c in range(0x110000)}}
    out = np.fromiter((of[unicodedata.category(chr(c))] for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


@cache
def lowered() -> np.ndarray:
    """Each letter's lower-case form where that is one code point, 0 for whatever is no letter."""
    kinds = classes()
    out = np.zeros(0x110000, np.uint32)
    for c in np.flatnonzero(kinds == LETTER).tolist():
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    return out


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 rows, and the offsets of the rows in them."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) == len(data):
        return codes, off
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return codes, before[off]
