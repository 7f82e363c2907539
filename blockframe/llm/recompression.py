"""Anchors of windows by recompression: rounds that name runs and pairs of symbols until a window holds a single consistent symbol."""

from __future__ import annotations

import numpy as np

from blockframe.llm.poly import Rolling, U, mix

#: Rounds of recompression, and consecutive symbols of the last round that name an anchor.
ROUNDS, RUN = 2, 3


def word_bounds(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array: runs without a space or 9 to 13."""
    inside = ~((flat == 32) | ((flat >= 9) & (flat <= 13)))
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def join_round(names: np.ndarray, at: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One more round: the symbols' names and where they begin (places in the words).

    A round joins two neighbours that are equal (runs) or of which the first has a 0 and the second a 1 in a bit
    of their names (pairs, and the runs that meet there), never across documents. What joins is decided by the two neighbours alone and a symbol is named by
    a fingerprint of what it is made of, so names are the same in every document and task without a table of names, and equal
    sequences get equal symbols but at their rims.
    """
    side = mix(names + U(0x632BE59BD9B4E019)) & U(1)
    join = (docs[at[1:]] == docs[at[:-1]]) & ((names[1:] == names[:-1]) | ((side[:-1] == 0) & (side[1:] == 1)))
    begin = np.flatnonzero(np.concatenate([[True], ~join]))
    end = np.append(begin[1:], len(names))
    fresh = Rolling(mix(names)).of(begin, end)
    return np.where(end - begin > 1, fresh, names[begin]), at[begin]


def _least(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place of the least key in each range [low, high), the first of equal ones. Keys count to 40 bits; ranges are not empty."""
    place = np.uint64(len(keys).bit_length())
    rows = [((keys >> U(24)) << place) | np.arange(len(keys), dtype=U)]
    span = high - low
    step = np.log2(span).astype(np.int64)
    out = np.zeros(len(low), U)
    for s in range(int(step.max(initial=0)) + 1):
        if s:
            last, half = rows[-1], 1 << (s - 1)
            rows.append(np.minimum(last[: max(0, len(last) - half)], last[half:]))
        at = np.flatnonzero(step == s)
        out[at] = np.minimum(rows[s][low[at]], rows[s][high[at] - (1 << s)])
    return (out & ((U(1) << place) - U(1))).astype(np.int64)


def anchors(words: np.ndarray, docs: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window [start, start + size): its anchor, a place in it, and the anchor's name. Windows of equal words have equal names and anchors at equal distance.

    Of each round's symbols those are safe in a window that begin and end strictly between safe symbols of the round before. A run
    of RUN safe symbols of the last round can be an anchor; of all in the window the one with the least name is, the first of equals. Windows without such a run take a single safe
    symbol, and windows without any take their first word, as for a word repeated throughout.
    """
    n = len(words)
    low, high = starts, starts + size
    names, at = words, np.arange(n)
    anchor, name = starts.copy(), mix(words[starts] + U(1))
    live = np.arange(len(starts))
    for _ in range(ROUNDS):
        names, at = join_round(names, at, docs)
        begins = np.zeros(n + 1, np.int32)
        begins[at] = 1
        upto = np.cumsum(begins, dtype=np.int32)  # symbols that begin at a place or before
        ends = np.append(at, n)
        low, high = ends[upto[low]], ends[upto[high - 1] - 1]
        good = low < high
        live, low, high = live[good], low[good], high[good]
    if not len(live):
        return anchor, name
    first, last = upto[low] - 1, upto[high - 1]  # symbols first to last - 1
    for run in (RUN, 1):
        keys = Rolling(mix(names)).of(np.arange(len(names) - run + 1), np.arange(run, len(names) + 1)) + U(run)
        fits = last - first >= run
        best = _least(keys, first[fits], last[fits] - run + 1) if fits.any() else np.zeros(0, np.int64)
        anchor[live[fits]], name[live[fits]] = at[best], keys[best]
        live, first, last = live[~fits], first[~fits], last[~fits]
    return anchor, name
