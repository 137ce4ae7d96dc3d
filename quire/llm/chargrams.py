"""Character n-grams of text batches as numbers, with numpy.

A character counts by its code point where that is below 4096, and by its remainder plus 2048 otherwise, so that five
characters fit in 60 bits: an n-gram's context and suffix are shifts and masks of its number, here and in SQL.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BITS = 12
#: Characters that one step of numpy work takes at most; longer texts are split at spaces.
STEP = 1 << 18


def normal(text: str | None) -> str:
    """Lower case, words with one space before each and one at the end; empty without words."""
    words = (text or "").lower().split()
    return f" {' '.join(words)} " if words else ""


def pieces(text: str) -> Iterator[str]:
    """A normal text in parts of about STEP characters that begin and end with a space."""
    at = 0
    while len(text) - at > STEP + 1:
        end = text.rfind(" ", at + 1, at + STEP)
        end = end if end > at else text.find(" ", at + STEP)
        if end < 0 or end >= len(text) - 1:
            break
        yield text[at : end + 1]
        at = end
    if at < len(text) - 1:
        yield text[at:]


def batches(texts: Iterable[str | None], gap: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, starts, codes): parts of texts end to end, each part's index of its text, and where it starts in codes.

    `gap` spaces stand around each word; with n - 1 of them no n-gram holds letters of two words.
    """
    wide = " " * gap
    owner: list[int] = []
    held: list[str] = []
    n = 0

    def made():
        lengths = np.array([len(x) for x in held], np.int64)
        points = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        codes = np.where(points < 4096, points, points % 2048 + 2048)
        return np.array(owner, np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]), codes

    for i, text in enumerate(texts):
        for part in pieces(normal(text)):
            part = part.replace(" ", wide) if gap > 1 else part
            owner.append(i)
            held.append(part)
            n += len(part)
            if n >= STEP:
                yield made()
                owner, held, n = [], [], 0
    if held:
        yield made()


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each position, as a number; those that end before position n - 1 hold less."""
    out = codes.copy()
    for k in range(1, n):
        out[k:] |= codes[:-k] << (BITS * k)
    return out


def inside(codes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """True where an n-gram lies within its part of the batch."""
    ok = np.ones(len(codes), bool)
    for k in range(n - 1):
        at = starts + k
        ok[at[at < len(codes)]] = False
    return ok
