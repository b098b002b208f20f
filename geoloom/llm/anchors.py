"""Anchors of texts: positions chosen by content, so that equal 200-byte strings choose equal ones.

Every window of `window` bytes takes the leftmost of its k-byte grams with the least hash as its anchor; windows in a row
share anchors. The context of an anchor is the stretch of bytes that its windows cover.
"""

from __future__ import annotations

import numpy as np

WINDOW = 200
GRAM = 48
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w values in a row: running minima of blocks of w, forward and backward, meet in it."""
    n = len(x)
    pad = -n % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


class Anchors:
    def __init__(self) -> None:
        n = PIECE + 2 * WINDOW
        ones = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, np.uint64(b), np.uint64))])
        self.up, self.down = ones(_BASE), ones(pow(_BASE, -1, 1 << 64))

    def of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each anchor: gram hash, context hash, and the first and last window that it is the anchor of."""
        out = []
        for at in range(0, max(1, len(raw) - WINDOW + 1), PIECE):
            x = np.frombuffer(raw, np.uint8, min(len(raw) - at, PIECE + WINDOW - 1), at)
            if len(x) >= WINDOW:
                out.append(self._piece(x, at))
        if not out:
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _piece(self, x: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
        n = len(x)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        gram = mix((total[GRAM:] - total[:-GRAM]) * self.down[: n - GRAM + 1])
        place = np.uint64((1 << 21) - 1)
        least = sliding_min((gram & ~place) | np.arange(len(gram), dtype=np.uint64), WINDOW - GRAM + 1)
        anchor = (least & place).astype(np.int64)
        edge = np.flatnonzero(np.diff(anchor)) + 1
        first = np.concatenate([[0], edge])
        last = np.concatenate([edge, [len(anchor)]]) - 1
        a = anchor[first]
        own = (total[last + WINDOW] - total[first]) * self.down[first]
        context = mix(own + mix((a - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)))
        return gram[a], context, first + at, last + at
