"""Near-duplicate classes by order MinHash, verified by banded alignment.

A text is its sequence of normalised words (lower-cased ASCII letters, digits and all that is not ASCII); its k-mers are
runs of five words, each labelled by its occurrence number. For every band, a keyed hash picks the four smallest
labelled k-mers, and their order in the text is kept: equal bands mean that two texts agree in content and in order, so
they are sensitive to edits, block moves included. Texts that share a band are candidates; a banded alignment of their
k-mer sequences decides: aligned k-mers / (all k-mers of both - aligned) must be 0.8 or more.

Equal texts are one node (by SHA-256). Classes are the connected components of the verified links.

In each bucket (texts with an equal band) every text is first held against one leader: the text with most company over
all its bands, so that the copies of one original meet in it. Then, in every bucket that holds several classes, all pairs
of texts of different classes are decided, in blocks: two texts are aligned if their common labelled k-mers allow the
similarity, and classes that a link joins aren't held against each other again. So no link that a bucket holds is lost;
two texts at a similarity of 0.8 share ten of the 24 bands on average.

Defined results: null is the empty text; texts without words are duplicates only of equal texts; a text of less than
five words is a single k-mer; rows without an id or with repeated ids are rows of their own; class_id is the least
doc_id of a class (null if none has one); long texts are hashed in pieces and aligned whole; an empty table gives an empty
result; other columns are ignored, or kept whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

K = 5
SIMILARITY = 0.8
BANDS = 24
PICK = 4
SEEDS = (np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(-1, 1)
PIECE = 1 << 19
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Sketcher:
    """k-mer hashes and bands of texts; holds the powers of the byte hash for PIECE bytes."""

    def __init__(self) -> None:
        ones = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * PIECE, np.uint64(b), np.uint64))])
        self.up, self.down = ones(_BASE), ones(pow(_BASE, -1, 1 << 64))
        code = np.arange(256)
        self.word = (code >= 128) | ((code >= 48) & (code <= 57)) | ((code >= 97) & (code <= 122))

    def words(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
        out, carry = [], raw[:0]
        for at in range(0, len(raw), PIECE):
            x = np.concatenate([carry, raw[at : at + PIECE]]) if len(carry) else raw[at : at + PIECE]
            on = self.word[x]
            carry = raw[:0]
            if at + PIECE < len(raw):  # a word at the seam moves to the next piece, unless it fills one
                off = np.flatnonzero(~on)
                cut = int(off[-1]) + 1 if len(off) else len(x)
                x, carry, on = x[:cut], x[cut:], on[:cut]
            edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            total = np.concatenate([[np.uint64(0)], np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.up[: len(x)])])
            out.append(mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def kmers(self, text: str) -> np.ndarray:
        w = self.words(text)
        n = min(K, len(w))
        if not n:
            return w
        h = np.zeros(len(w) - n + 1, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x2545F4914F6CDD1D) + w[j : len(w) - n + 1 + j]
        return mix(h)

    @staticmethod
    def labelled(kmers: np.ndarray) -> np.ndarray:
        """A hash of each k-mer with its occurrence number: all different in a text."""
        n = len(kmers)
        order = np.argsort(kmers, kind="stable")
        ranked = kmers[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])[:n]
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        label = np.empty(n, np.uint64)
        label[order] = mix(ranked + (np.arange(n) - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return label

    @staticmethod
    def bands(kmers: np.ndarray) -> np.ndarray:
        """A key for every band (none without k-mers)."""
        n = len(kmers)
        if not n:
            return np.zeros(0, np.uint64)
        label = Sketcher.labelled(kmers)
        pick = min(PICK, n)
        out = []
        step = max(1, (1 << 18) // n)
        for at in range(0, BANDS, step):
            h = mix(label[None, :] ^ SEEDS[at : at + step])
            best = np.argpartition(h, pick - 1, axis=1)[:, :pick] if n > pick else np.broadcast_to(np.arange(n), (len(h), n))
            best = np.sort(best, axis=1)  # text order
            key = SEEDS[at : at + step, 0].copy()
            for j in range(pick):
                key = mix(key * np.uint64(31) + label[best[:, j]])
            out.append(key)
        return np.concatenate(out)


def common_kmers(labels: list[np.ndarray]) -> np.ndarray:
    """How many labelled k-mers every two texts have in common: a matrix over at most a few hundred texts.

    k-mers of many texts are counted by products of 0/1 matrices, the others by their pairs, in pieces.
    """
    n = len(labels)
    out = np.zeros((n, n), np.float32)
    row = np.repeat(np.arange(n), [len(x) for x in labels])
    _, code, count = np.unique(np.concatenate(labels), return_inverse=True, return_counts=True)
    few = max(4, n // 32)
    for dense in (True, False):
        wanted = (count > few) if dense else (count > 1) & (count <= few)
        own = np.flatnonzero(wanted[code])
        own = own[np.argsort(code[own], kind="stable")]
        if dense:
            place = (np.cumsum(wanted) - 1)[code[own]]
            for at in range(0, int(wanted.sum()), 2048):
                a, b = np.searchsorted(place, [at, at + 2048])
                x = np.zeros((n, 2048), np.float32)
                x[row[own[a:b]], place[a:b] - at] = 1
                out += x @ x.T
        else:
            times = count[code[own]]
            for c in np.unique(times).tolist():
                rows = row[own[times == c]].reshape(-1, c)
                for at in range(0, len(rows), max(1, (1 << 21) // (c * c))):
                    r = rows[at : at + max(1, (1 << 21) // (c * c))]
                    out += np.bincount((r[:, :, None] * n + r[:, None, :]).ravel(), minlength=n * n).reshape(n, n)
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two k-mer sequences: aligned / (len(a) + len(b) - aligned), or 0.0 if it can't reach `least`.

    The alignment is a longest common subsequence within a band around the diagonal: at `least`, no more than so many
    k-mers can be left out on either side.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    need = least * (n + m) / (1 + least)  # aligned k-mers wanted
    if min(n, m) < need:
        return 0.0
    if n == m and np.array_equal(a, b):
        return 1.0
    # Common ends are aligned in any case.
    size = min(n, m)
    same = a[:size] == b[:size]
    head = size if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    size = min(len(a), len(b))
    tail = 0
    if size:
        same = a[::-1][:size] == b[::-1][:size]
        tail = size if same.all() else int(np.argmin(same))
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    score = head + tail + _lcs(a, b, need - head - tail, n - need, m - need)
    return score / (n + m - score) if score >= need - 1e-9 else 0.0


def _lcs(a: np.ndarray, b: np.ndarray, need: float, skip_a: float, skip_b: float) -> int:
    """Longest common subsequence that leaves out at most skip_a of a and skip_b of b (as far as that matters)."""
    if not len(a) or not len(b):
        return 0
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    low, high = np.searchsorted(ranked, a, "left"), np.searchsorted(ranked, a, "right")
    times = high - low
    if (times > 0).sum() < need:
        return 0
    if int(times.sum()) > 16 * (len(a) + len(b)):  # k-mers that repeat very often
        values = np.unique(a[times > 0])
        if len(values) * len(b) <= 1 << 29:
            return _lcs_by_bits(a, b, values)
    # Every pair of equal k-mers in the band, in order: the longest rising chain of positions (patience sorting).
    left, right = int(skip_a) + 1, int(skip_b) + 1  # j - i is within [-left, right]
    tops: list[int] = []
    for i in np.flatnonzero(times > 0).tolist():
        lo, hi = int(low[i]), int(high[i])
        if hi - lo > 1:
            own = order[lo:hi]  # rising
            js = own[np.searchsorted(own, i - left) : np.searchsorted(own, i + right, "right")][::-1].tolist()
        else:
            j = int(order[lo])
            js = (j,) if -left <= j - i <= right else ()
        for j in js:
            at = bisect_left(tops, j)
            if at == len(tops):
                tops.append(j)
            elif tops[at] > j:
                tops[at] = j
    return len(tops)


def _lcs_by_bits(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> int:
    """The same by bit-parallel dynamic programming: a row of the table is the bits of one integer."""
    masks = {int(v): int.from_bytes(np.packbits(b == v, bitorder="little").tobytes(), "little") for v in values}
    full = (1 << len(b)) - 1
    row = full
    for v in a.tolist():
        mask = masks.get(v)
        if mask:
            up = row & mask
            row = ((row + up) | (row - up)) & full
    return len(b) - row.bit_count()
