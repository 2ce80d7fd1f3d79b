"""Sorting the suffixes of one block of text, to a fixed depth, with a difference cover.

A suffix here is a start in the block of which the first DEPTH bytes count. Suffixes are sorted by their first COVER
bytes. Those that tie are compared by the ranks of cover positions: for any two starts some shift below COVER puts both
on the cover, and the precomputed rank of the text there (RANKED bytes) decides; the last COVER bytes settle the rest.
So no comparison walks along the text, and memory is a few numbers for each byte of the block.
"""

from __future__ import annotations

import numpy as np

DEPTH = 100
#: A difference cover modulo COVER: each number below COVER is a difference of two of these.
COVER = 32
COVER_SET = (0, 1, 2, 3, 7, 11, 19)


def shifts() -> np.ndarray:
    """For residues x, y: the smallest shift that puts both on the cover."""
    on = np.zeros(COVER, bool)
    on[list(COVER_SET)] = True
    out = np.zeros((COVER, COVER), np.int64)
    for x in range(COVER):
        for y in range(COVER):
            out[x, y] = next(d for d in range(COVER) if on[(x + d) % COVER] and on[(y + d) % COVER])
    return out


SHIFTS = shifts()


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number in the order of bytes; zeros stand after the end."""
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text) + 8, np.uint64)[: len(text)]
    for k in range(8):
        out = (out << np.uint64(8)) | wide[k : k + len(text)]
    return out


def dense(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank of each in order) by the keys, first key first; equal ones share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def cover_ranks(words: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """At each cover position from which depth - COVER + 1 bytes lie before its end: the rank of those bytes; -1 elsewhere."""
    ranked = depth - COVER + 1
    on = np.zeros(COVER, bool)
    on[list(COVER_SET)] = True
    at = np.flatnonzero(on[np.arange(len(words)) % COVER] & (np.arange(len(words)) + ranked <= ends))
    places = [*range(0, ranked - 8, 8), ranked - 8]
    order, rank = dense([words[at + p] for p in places])
    out = np.full(len(words), -1, np.int64)
    out[at[order]] = rank
    return out


def sorted_suffixes(text: np.ndarray, ends: np.ndarray, starts: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(starts in the order of their first depth bytes, class of each: equal ones share a number, rising).

    text: bytes; ends: for each byte, where its piece ends; every start has depth bytes before its piece's end.
    depth must be at least 2 * COVER.
    """
    if depth < 2 * COVER:
        raise ValueError(f"depth must be at least {2 * COVER}")
    if not len(starts):
        return starts, np.zeros(0, np.int64)
    words = words_at(text)
    rank = cover_ranks(words, ends, depth)
    order, tie = dense([words[starts + p] for p in range(0, COVER, 8)])
    starts = starts[order]
    first = np.flatnonzero(np.diff(tie, prepend=-1))
    group = first[tie]  # the place of its first member
    tail = [depth - COVER + p for p in range(0, COVER, 8)]
    todo = np.arange(len(starts))
    # Each round splits every unsettled group at one of its members into less, equal and greater.
    while True:
        first = np.flatnonzero(np.diff(group[todo], prepend=-1))
        n = np.diff(first, append=len(todo))
        todo, n = todo[np.repeat(n > 1, n)], n[n > 1]
        if not len(todo):
            return starts, group
        first = np.cumsum(n) - n
        of = np.repeat(np.arange(len(n)), n)
        own, pivot = starts[todo], starts[todo[first + n // 2]][of]
        shift = SHIFTS[own % COVER, pivot % COVER]
        sign = np.sign(rank[own + shift] - rank[pivot + shift])
        for p in tail:
            same = np.flatnonzero(sign == 0)
            a, b = words[own[same] + p], words[pivot[same] + p]
            sign[same] = (a > b).astype(np.int64) - (a < b)
        key = of * 3 + sign
        order = np.argsort(key, kind="stable")
        starts[todo] = own[order]
        split = np.diff(key[order], prepend=-9) != 0
        group[todo] = todo[np.maximum.accumulate(np.where(split, np.arange(len(todo)), 0))]
        todo = todo[sign[order] != 0]
