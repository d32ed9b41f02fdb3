"""Content-chosen anchors: from every window of ``window`` units the k units with the least hash.

Equal windows choose the same anchor at the same place, whatever surrounds them.  So all
occurrences of a window meet under the hash of its anchor, at about 2 rows for
``window - k`` units instead of one row for each unit.  With an anchor goes the hash
of its neighbourhood, i.e. all units that any window choosing it can cover.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import Rolling, mix

_PLACE = np.uint64((1 << 24) - 1)
#: Units whose places are numbered at once, 2**24 at most; a longer slice is searched in pieces that overlap.
PIECE = 1 << 24


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each run of w values."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = -n % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


@dataclass
class Anchors:
    doc: np.ndarray  #: number of the text in the slice
    place: np.ndarray  #: unit in the text where the anchor begins
    left: np.ndarray  #: units of the neighbourhood before it
    right: np.ndarray  #: units of the neighbourhood from it on
    key: np.ndarray
    around: np.ndarray
    chosen: np.ndarray | None = None  #: for each window start of the slice the unit of its anchor, -1 where a text ends


def anchors(values: np.ndarray, offsets: np.ndarray, window: int, k: int) -> Anchors:
    """Anchors of texts given as one array of unit hashes; text i is ``values[offsets[i]:offsets[i + 1]]``."""
    n, w = len(values), window - k + 1
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return Anchors(none, none, none, none, none.view(np.uint64), none.view(np.uint64), np.full(n, -1))
    rolling = Rolling(values)
    grams = rolling.every(k)
    least = np.empty(n - window + 1, dtype=np.int64)
    # windows that begin in a piece reach w - 1 k-mers beyond it
    for a in range(0, len(least), max(PIECE - w + 1, 1)):
        part = mix(grams[a : a + max(PIECE, w)]) & ~_PLACE
        part |= np.arange(len(part), dtype=np.uint64)
        found = (sliding_min(part, w) & _PLACE).astype(np.int64)
        least[a : a + len(found)] = found + a
    room = np.zeros(n + 1, dtype=np.int64)  # 1 where a window can begin
    lens = np.diff(offsets)
    ok = lens >= window
    np.add.at(room, offsets[:-1][ok], 1)
    np.add.at(room, offsets[1:][ok] - window + 1, -1)
    fits = np.cumsum(room[:n]) > 0
    chosen = np.full(n, -1, dtype=np.int64)
    chosen[: len(least)] = least
    chosen[~fits] = -1
    mark = np.zeros(n, dtype=bool)
    mark[chosen[fits]] = True
    at = np.flatnonzero(mark)
    doc = np.searchsorted(offsets, at, side="right") - 1
    left = np.minimum(w - 1, at - offsets[doc])
    right = np.minimum(w - 1 + k, offsets[doc + 1] - at)
    around = rolling.ranges(at - left, at + right) ^ mix((left * 65536 + right).astype(np.uint64))
    return Anchors(doc, at - offsets[doc], left, right, grams[at], around, chosen)
