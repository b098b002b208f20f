"""External induced suffix sorting, with common-prefix values.

The string is over 0..256, where 0 separates texts (never two in a row) and comes last. Suffixes that begin a rise after
a fall (LMS suffixes) are sorted first: the pieces between them get names in order, and the names are refined until they
tell suffixes apart as far as wanted. From them all others are induced: the sorted suffixes pass as one stream of tuples
(position, common prefix with the one before), and each puts its left neighbour into the queue of that neighbour's first
character, with one more than the least common prefix since the last that went there. A queue is first-in-first-out, so
the queues together are a priority queue by character and arrival; suffixes that begin like their right neighbour come
back to the queue that is being read. One pass goes up for the falling suffixes, one down for the rising.

Memory: everything is worked in blocks, and whatever exceeds `budget` bytes (the string, names, queues, the falling
suffixes between the passes) is kept in scratch files of the task, so a string may be far larger than the budget.

Order and common prefixes are exact up to `depth` characters; longer common prefixes are given as `depth` or more.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

BITS, PACK = 9, 7  # a packed word holds seven characters of nine bits
CHARS = 6  # characters of ten bits that one key of a piece holds
TOP = 257
HIGH = np.uint16(60_000)  # no common prefix is given as more
NONE = (np.zeros(0, np.int64), np.zeros(0, np.uint16))


class Scratch:
    """Arrays in memory up to a budget, and in scratch files beyond it."""

    def __init__(self, budget: int):
        self.budget, self.used, self.spilled = budget, 0, 0
        self.block = max(256, budget // 256)
        self.files: list = []

    def array(self, n: int, dtype: object) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if self.used + size <= self.budget // 2 or not n:
            self.used += size
            return np.empty(n, dtype)
        self.spilled += size
        self.files.append(tempfile.TemporaryFile())
        return np.memmap(self.files[-1], dtype, "w+", shape=(n,))

    def blocks(self, n: int) -> Iterator[tuple[int, int]]:
        for a in range(0, n, self.block):
            yield a, min(a + self.block, n)


class Queues:
    """A queue of (positions, common prefixes) per character; what exceeds `budget` bytes goes to a scratch file."""

    def __init__(self, budget: int):
        self.chunks: dict[int, deque] = {}
        self.used: set[int] = set()
        self.size, self.budget, self.spilled = 0, budget, 0
        self.file = None

    def put(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.used.add(c)
        if self.size + pos.nbytes + lcp.nbytes > self.budget:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(pos.tobytes() + lcp.tobytes())
            self.spilled += pos.nbytes + lcp.nbytes
            self.chunks.setdefault(c, deque()).append((at, len(pos)))
        else:
            self.size += pos.nbytes + lcp.nbytes
            self.chunks.setdefault(c, deque()).append((pos, lcp))

    def _load(self, chunk: tuple) -> tuple[np.ndarray, np.ndarray]:
        a, b = chunk
        if isinstance(a, np.ndarray):
            self.size -= a.nbytes + b.nbytes
            return a, b
        self.file.seek(a)
        raw = self.file.read(b * 10)
        return np.frombuffer(raw, np.int64, b), np.frombuffer(raw, np.uint16, b, b * 8)

    def take(self, c: int, block: int, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The next chunks of a queue, about a block of them, or its last chunk; None if it is empty."""
        own = self.chunks.get(c)
        if not own:
            return None
        if last:
            return self._load(own.pop())
        out, n = [], 0
        while own and n < block:
            out.append(self._load(own.popleft()))
            n += len(out[-1][0])
        return out[0] if len(out) == 1 else (np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out]))


def _least_between(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of values[start:end] for each pair, by a table of the least of every power of two in a row."""
    if not len(start):
        return np.zeros(0, values.dtype)
    size = end - start
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(start), values.dtype)
    row = values
    for k in range(int(level.max()) + 1):
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(row[start[own]], row[end[own] - (1 << k)])
        if len(row) > (1 << k):
            row = np.minimum(row[: len(row) - (1 << k)], row[1 << k :])
    return out


def _scan(text: np.ndarray, s: Scratch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each suffix rises, the packed characters from each position on, and the LMS positions."""
    n = len(text)
    rising, packed = s.array(n, np.uint8), s.array(n, np.uint64)
    for a, b in reversed(list(s.blocks(n))):
        x = np.asarray(text[a : min(b + PACK, n)]).astype(np.int32)
        ahead = x[1 : b - a + 1] if b < n else np.append(x[1 : b - a], -1)  # the last character falls to the end ...
        step = np.sign(ahead - x[: b - a])
        up = np.where(step > 0, 1, 0).astype(np.uint8)
        place = np.arange(b - a)
        run_end = np.minimum.accumulate(np.where(step != 0, place, b - a)[::-1])[::-1]
        known = run_end < b - a
        up[known] = up[run_end[known]]
        if b < n:
            up[~known] = rising[b]
        if b == n:
            up[-1] = 1  # ... but counts as a rise
        rising[a:b] = up
        padded = np.concatenate([x, np.zeros(PACK, np.int32)]).astype(np.uint64)
        word = np.zeros(b - a, np.uint64)
        for k in range(PACK):
            word = (word << np.uint64(BITS)) | padded[k : k + b - a]
        packed[a:b] = word
    is_lms = lambda a, b: np.flatnonzero((rising[a:b] == 1) & ((rising[a - 1 : b - 1] == 0) if a else np.concatenate([[False], rising[: b - 1] == 0]))) + a
    m = sum(len(is_lms(a, b)) for a, b in s.blocks(n))
    lms, at = s.array(m, np.int64), 0
    for a, b in s.blocks(n):
        own = is_lms(a, b)
        lms[at : at + len(own)] = own
        at += len(own)
    return rising, packed, lms


def _refine(order: np.ndarray, rank: np.ndarray, todo: list[tuple[int, int]], key: Callable[[np.ndarray], np.ndarray], s: Scratch) -> list[tuple[int, int]]:
    """Sorts every group of equal ranks by the members' keys and ranks them anew. order: members by rank; a rank is the
    place of its group's first member. todo: ranges of whole groups; gives the ranges that still hold ties."""
    left: list[tuple[int, int]] = []
    stack = todo[::-1]
    while stack:
        a, b = stack.pop()
        if b - a > s.block:  # cut where a group begins, or deal out a group that is larger than a block
            heads = np.asarray(rank[np.asarray(order[a : a + s.block + 1])])
            cut = a + int(np.searchsorted(heads, heads[-1]))
            if cut > a:
                stack += [(cut, b), (a, cut)]
                continue
            end, step = a + s.block, s.block
            while end < b and rank[order[min(end + step, b) - 1]] == heads[0]:
                end = min(end + step, b)
            if end < b:
                end += int(np.searchsorted(np.asarray(rank[np.asarray(order[end : min(end + step, b)])]), heads[0], "right"))
                stack.append((end, b))
            stack += _deal(order, rank, a, end, key, s, left)[::-1]
            continue
        idx = np.asarray(order[a:b])
        r, k = np.asarray(rank[idx]), key(idx)
        by = np.lexsort((k, r))
        idx, r, k = idx[by], r[by], k[by]
        fresh = np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])
        heads = np.flatnonzero(fresh)
        order[a:b] = idx
        rank[idx] = a + heads[np.cumsum(fresh) - 1]
        sizes = np.diff(np.append(heads, b - a))
        tied = heads[sizes > 1]
        if len(tied):  # neighbours in one range, so that ranges stay few
            left.append((a + int(tied[0]), a + int(tied[-1] + sizes[sizes > 1][-1])))
    return left


def _deal(order: np.ndarray, rank: np.ndarray, a: int, b: int, key: Callable[[np.ndarray], np.ndarray], s: Scratch, left: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A group too large for a block, dealt by keys between splitters: every part becomes a group with a rank of its own.

    Parts of several keys are returned, to be sorted on; parts of one key stay tied (left).
    """
    sample = np.sort(np.concatenate([key(np.asarray(order[x : min(x + 64, b)])) for x in range(a, b, max(64, (b - a) // 64))]))
    cuts = np.unique(sample[:: max(1, len(sample) // 32)])
    part_of = lambda k: 2 * np.searchsorted(cuts, k, "left") + np.isin(k, cuts)  # noqa: E731  # a key that is a splitter has a part of its own
    n_parts = 2 * len(cuts) + 2
    counts = np.zeros(n_parts, np.int64)
    for x, y in ((p + a, q + a) for p, q in s.blocks(b - a)):
        counts += np.bincount(part_of(key(np.asarray(order[x:y]))), minlength=n_parts)
    start = a + np.concatenate([[0], np.cumsum(counts)])
    new, at = s.array(b - a, order.dtype), start[:-1].copy()
    for x, y in ((p + a, q + a) for p, q in s.blocks(b - a)):
        idx = np.asarray(order[x:y])
        part = part_of(key(idx))
        by = np.argsort(part, kind="stable")
        part, idx = part[by], idx[by]
        within = np.arange(len(idx)) - np.searchsorted(part, part)
        new[at[part] + within - a] = idx
        at += np.bincount(part, minlength=n_parts)
    for x, y in s.blocks(b - a):
        order[a + x : a + y] = new[x:y]
    more = []
    for p in np.flatnonzero(counts).tolist():
        x, y = int(start[p]), int(start[p + 1])
        for u, v in s.blocks(y - x):
            rank[np.asarray(order[x + u : x + v])] = x
        if p % 2 == 0 or y - x == b - a:  # several keys; or nothing was told apart
            (more if y - x < b - a else left).append((x, y))
        elif y - x > 1:
            left.append((x, y))
    return more


def _common(packed: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix lengths of suffix pairs, up to the first multiple of PACK that is depth or more."""
    n = len(packed)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    steps = np.uint64(1) << (np.arange(1, PACK + 1, dtype=np.uint64) * np.uint64(BITS))
    at = 0
    while at < depth and len(live):
        i, j = a[live] + at, b[live] + at
        x = np.asarray(packed[np.minimum(i, n - 1)]) ^ np.asarray(packed[np.minimum(j, n - 1)])
        inside = (i < n) & (j < n)
        same = inside & (x == 0)
        part = np.where(inside, PACK - 1 - np.searchsorted(steps, x, "right"), 0)
        out[live] = at + np.where(same, PACK, np.maximum(part, 0))
        live = live[same]
        at += PACK
    return out


def _sorted_lms(text: np.ndarray, rising: np.ndarray, packed: np.ndarray, lms: np.ndarray, depth: int, s: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """LMS positions in the order of their suffixes, and the common prefix of each with the one before (both as far as depth)."""
    n, m = len(text), len(lms)
    order, rank = s.array(m, np.int64), s.array(m, np.int64)
    for a, b in s.blocks(m):
        order[a:b], rank[a:b] = np.arange(a, b), 0
    todo = [(0, m)] if m > 1 else []
    for at in range(0, depth + CHARS, CHARS):  # the pieces up to the next LMS position, a few characters at a time

        def of_piece(idx: np.ndarray, at: int = at) -> np.ndarray:
            start, end = np.asarray(lms[idx]), np.asarray(lms[np.minimum(idx + 1, m - 1)])
            out = np.zeros(len(idx), np.uint64)
            for k in range(CHARS):
                p = np.minimum(start + at + k, n - 1)
                code = np.asarray(text[p]).astype(np.uint64) * np.uint64(2) + np.asarray(rising[p]).astype(np.uint64) + np.uint64(1)
                out = (out << np.uint64(10)) | np.where(start + at + k <= end, code, np.uint64(0))
            return out

        before = todo
        todo = _refine(order, rank, todo, of_piece, s)
        if not todo or (at and todo == before and not _longer(order, lms, todo, at + CHARS, s)):
            break
    step = 1
    while todo and 2 * step < depth + 2 * PACK:  # names of `step` pieces in a row, doubled; a piece spans two characters at least

        def of_names(idx: np.ndarray, step: int = step) -> np.ndarray:
            after = idx + step
            return np.where(after < m, np.asarray(rank[np.minimum(after, m - 1)]) + 1, 0)

        todo = _refine(order, rank, todo, of_names, s)
        step *= 2
    common = s.array(m, np.uint16)
    for a, b in s.blocks(m):
        own = np.asarray(lms[np.asarray(order[max(a - 1, 0) : b])])
        found = np.minimum(_common(packed, own[:-1], own[1:], depth), HIGH)
        common[a:b] = found if a else np.concatenate([[0], found])
    for a, b in s.blocks(m):
        order[a:b] = lms[np.asarray(order[a:b])]
    return order, common


def _longer(order: np.ndarray, lms: np.ndarray, todo: list[tuple[int, int]], at: int, s: Scratch) -> bool:
    """Whether a piece of those that tie goes on after so many characters."""
    m = len(lms)
    for a, b in todo:
        for x, y in ((p + a, q + a) for p, q in s.blocks(b - a)):
            idx = np.asarray(order[x:y])
            if (np.asarray(lms[np.minimum(idx + 1, m - 1)]) - np.asarray(lms[idx]) >= at).any():
                return True
    return False


def sorted_suffixes(text: np.ndarray, depth: int, budget: int, stats: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (positions, common prefix with the one before in the stream), from the last suffix in order to the first.

    Suffixes that begin with 0 are left out. stats gets the bytes that went to scratch files.
    """
    s = Scratch(budget)
    n = len(text)
    rising, packed, lms = _scan(text, s)
    seeds, seed_lcp = _sorted_lms(text, rising, packed, lms, depth, s)
    del rising, packed, lms
    m = len(seeds)
    cut = np.zeros(TOP + 1, np.int64)
    for a, b in s.blocks(m):
        cut[1:] += np.bincount(np.asarray(text[np.asarray(seeds[a:b])]), minlength=TOP)
    cut = np.cumsum(cut)

    def run(p: int) -> int:
        """How many characters in a row are that at p."""
        own = np.asarray(text[p : p + int(HIGH)])
        other = np.flatnonzero(own != own[0])
        return int(other[0]) if len(other) else len(own)

    def induce(queues: Queues, carry: np.ndarray, pos: np.ndarray, lcp: np.ndarray, fits: Callable[[np.ndarray], np.ndarray]) -> None:
        """Puts the left neighbours that fit into their queues; carry: the least common prefix since each queue's last."""
        before = np.where(pos > 0, np.asarray(text[np.maximum(pos - 1, 0)]).astype(np.int64), -1)
        own = np.flatnonzero((pos > 0) & fits(before))
        running = np.minimum.accumulate(lcp)
        if not len(own):
            np.minimum(carry, running[-1], out=carry)
            return
        own = own[np.argsort(before[own], kind="stable")]
        chars = before[own]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(chars)) + 1])
        inner = np.ones(len(own), bool)
        inner[edge] = False
        prior = np.concatenate([[0], own[:-1]])
        least = np.zeros(len(own), np.uint16)
        least[inner] = _least_between(lcp, prior[inner] + 1, own[inner] + 1)
        least[edge] = np.minimum(running[own[edge]], carry[chars[edge]])
        values = np.minimum(least, HIGH) + np.uint16(1)
        ends = np.append(edge[1:], len(own))
        np.minimum(carry, running[-1], out=carry)
        tail = np.minimum.accumulate(lcp[::-1])[::-1]
        for a, b in zip(edge.tolist(), ends.tolist(), strict=True):
            c = int(chars[a])
            if c not in queues.used:
                values[a] = 0
            queues.put(c, pos[own[a:b]] - 1, values[a:b].copy())
            last = int(own[b - 1])
            carry[c] = tail[last + 1] if last + 1 < len(lcp) else HIGH

    queues, carry = Queues(budget // 4), np.full(TOP, HIGH, np.uint16)
    falls = Queues(budget // 4)
    for c in range(TOP):
        last = -1
        while (got := queues.take(c, s.block)) is not None:
            falls.put(c, *got)
            last = int(got[0][-1])
            induce(queues, carry, *got, lambda b, c=c: b >= c)
        for a in range(int(cut[c]), int(cut[c + 1]), s.block):
            pos, lcp = np.asarray(seeds[a : min(a + s.block, int(cut[c + 1]))]), np.array(seed_lcp[a : min(a + s.block, int(cut[c + 1]))])
            if a == cut[c]:
                lcp[0] = min(run(last), run(int(pos[0]))) if last >= 0 else 0
            induce(queues, carry, pos, lcp, lambda b, c=c: b > c)
    spilled = s.spilled + queues.spilled + falls.spilled
    queues, carry = Queues(budget // 4), np.full(TOP, HIGH, np.uint16)
    for c in range(TOP - 1, 0, -1):
        last, first = -1, True
        while (got := queues.take(c, s.block)) is not None:
            last, first = int(got[0][-1]), False
            yield got
            induce(queues, carry, *got, lambda b, c=c: (b <= c) & (b > 0))
        above = None  # the common prefix of the fall last seen with the one below it
        while (got := falls.take(c, s.block, True)) is not None:
            pos, lcp = got[0][::-1], got[1]
            if above is None:
                above = min(run(last), run(int(pos[0]))) if last >= 0 else 0
            down = np.concatenate([[above], lcp[1:][::-1]]).astype(np.uint16)
            above = int(lcp[0])
            yield pos, down
            induce(queues, carry, pos, down, lambda b, c=c: (b < c) & (b > 0))
    if stats is not None:
        stats["spilled"] = spilled + queues.spilled


def suffix_order(text: np.ndarray, depth: int = 200, budget: int = 64 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order, and the common prefix of each suffix with the one before it. The last character is 0."""
    found = list(sorted_suffixes(text, depth, budget)) or [NONE]
    pos, lcp = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    return pos[::-1], np.concatenate([[0], lcp[1:][::-1]]).astype(np.uint16) if len(lcp) else lcp


def repeated(text: np.ndarray, depth: int, budget: int, stats: dict | None = None) -> np.ndarray:
    """A flag per position: its suffix has depth characters or more in common with another."""
    out = Scratch(budget).array(len(text), np.uint8)
    out[:] = 0
    before = -1
    for pos, lcp in sorted_suffixes(text, depth, budget, stats):
        high = np.flatnonzero(lcp >= depth)
        out[pos[high]] = 1
        out[pos[high[high > 0] - 1]] = 1
        if len(high) and high[0] == 0 and before >= 0:
            out[before] = 1
        before = int(pos[-1])
    return out
