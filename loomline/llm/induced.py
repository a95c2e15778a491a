"""External induced suffix sorting with common-prefix values, in numpy.

The suffixes of a sequence of small numbers are put in order by inducing: the sorted
S* suffixes seed a queue keyed by (first symbol, order of arrival); taking suffixes from
it in ascending order yields the L suffixes, and a second queue, in descending order,
the S suffixes. A queue carries tuples (position, common prefix with the one before it);
a common-prefix value is induced as one more than the least value since the last tuple
that went to the same symbol. Queues keep a bounded number of tuples in memory and the
rest in an unnamed scratch file, read back in blocks; tuples of a whole block are induced
at once. Only queues spill: the sequence and the arrays beside it are held in memory, so a
shard must fit there.

Common-prefix values are capped at `depth`, and suffixes that agree on `depth` symbols
stand next to each other in any order: all that a search for repeats of that length needs.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Tuples that one queue keeps in memory.
IN_MEMORY = 1 << 23
BLOCK = 1 << 20


class TupleQueue:
    """First in, first out for each symbol; symbols are taken in ascending or descending order."""

    def __init__(self, symbols: int, in_memory: int = IN_MEMORY):
        self._held: list[list[np.ndarray | tuple[int, int]]] = [[] for _ in range(symbols)]
        self._count, self._limit, self._file = 0, in_memory, None

    def push(self, symbol: int, position: np.ndarray, common: np.ndarray) -> None:
        block = np.empty(len(position), [("p", np.int64), ("c", np.uint8)])
        block["p"], block["c"] = position, common
        if self._count + len(block) > self._limit:
            if self._file is None:
                self._file = tempfile.TemporaryFile()  # noqa: SIM115 - has no name and goes with the task
            at = self._file.seek(0, 2)
            self._file.write(block.tobytes())
            self._held[symbol].append((at, len(block)))
        else:
            self._count += len(block)
            self._held[symbol].append(block)

    def pop(self, symbol: int):
        """All that has been pushed for the symbol so far, in blocks; later pushes come with the next call."""
        held, self._held[symbol] = self._held[symbol], []
        small: list[np.ndarray] = []
        for x in held:
            if isinstance(x, tuple):
                if small:
                    yield np.concatenate(small)
                    small = []
                at, n = x
                while n:
                    k = min(n, BLOCK)
                    self._file.seek(at)
                    yield np.frombuffer(self._file.read(9 * k), [("p", np.int64), ("c", np.uint8)])
                    at, n = at + 9 * k, n - k
            else:
                self._count -= len(x)
                small.append(x)
        if small:
            yield np.concatenate(small)

    def close(self) -> None:
        if self._file is not None:
            self._file.close()


class _Inducer:
    """Sends the suffix before each one taken to its symbol's queue, with its common prefix."""

    def __init__(self, queue: TupleQueue, symbols: int, depth: int):
        self.queue, self.depth = queue, depth
        self.since = np.zeros(symbols, np.uint8)  # least common prefix since the last push to each symbol
        self.empty = np.ones(symbols, bool)

    def take(self, common: np.ndarray, position: np.ndarray, before: np.ndarray, go: np.ndarray) -> None:
        """common, position: what was taken, in order; before: its preceding symbol; go: whether that suffix is induced."""
        if not len(common):
            return
        at = np.flatnonzero(go)
        symbol = before[at]
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        seen = np.minimum(self.since, common.min())
        if not len(at):
            self.since = seen
            return
        cuts = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
            s, own = int(symbol[lo]), at[lo:hi]
            start = np.empty(len(own), np.int64)
            start[0], start[1:] = 0, own[:-1] + 1
            least = np.minimum.reduceat(common[: own[-1] + 1], start)
            least[0] = min(least[0], self.since[s])
            value = np.minimum(least, self.depth - 1) + np.uint8(1)
            if self.empty[s]:
                value[0], self.empty[s] = 0, False
            self.queue.push(s, position[own] - 1, value)
            seen[s] = common[own[-1] + 1 :].min(initial=255)
        self.since = seen


def _runs(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each suffix is of type S, how often its first symbol repeats, capped at 255)."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])  # the last place of each run but the last one
    last = np.append(change, n - 1)
    rising = np.append(t[change] < t[change + 1], False)
    size = np.diff(np.r_[-1, last])
    s_type = np.repeat(rising, size)
    left = np.repeat(last.astype(np.int32), size)
    left -= np.arange(n, dtype=np.int32)
    return s_type, (np.minimum(left, 254) + 1).astype(np.uint8)


def _sort_seeds(t: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions in the order of their first `depth` symbols, and the common prefix with the one before."""
    bits = int(t.max(initial=0) + 1).bit_length()
    per = 62 // bits
    padded = np.concatenate([t.astype(np.int32) + 1, np.zeros(depth + per, np.int32)])

    def key(p: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(p), np.int64)
        for j in range(per):
            out = (out << bits) | (padded[p + k * per + j] if k * per + j < depth else 0)
        return out

    common = np.zeros(len(at), np.uint8)
    if not len(at):
        return at, common
    first = key(at, 0)
    order = np.argsort(first, kind="stable")
    at, now = at[order].copy(), first[order]
    open_ = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    for k in range(-(-depth // per)):
        if k:
            now = key(at[open_], k)
            order = np.lexsort((now, group))
            at[open_], now = at[open_][order], now[order]
        same_group = np.r_[False, group[1:] == group[:-1]]
        same = same_group & np.r_[False, now[1:] == now[:-1]]
        differ = same_group & ~same
        if differ.any():
            x = now[differ] ^ now[np.flatnonzero(differ) - 1]
            high = np.floor(np.log2(x.astype(np.float64))).astype(np.int64)
            high += (x >> np.minimum(high + 1, 62)) > 0
            high -= (x >> high) == 0
            common[open_[differ]] = np.minimum(k * per + (per - 1 - high // bits), depth)
        number = np.cumsum(~same)
        tied = same.copy()
        tied[:-1] |= same[1:]
        open_, group = open_[tied], number[tied]
        if not len(open_):
            break
    if len(open_):
        rest = np.r_[False, group[1:] == group[:-1]]
        common[open_[rest]] = depth
    return at, common


def suffix_blocks(t: np.ndarray, depth: int, in_memory: int = IN_MEMORY):
    """(positions, common prefix with the suffix before) of all suffixes, one symbol after the other, descending.

    t: numbers from 0, small against the length. Within a symbol suffixes ascend.
    """
    n = len(t)
    if n == 0:
        return
    symbols = int(t.max()) + 1
    s_type, run = _runs(t)
    before = np.empty_like(t)
    before[1:], before[:1] = t[:-1], 0
    seeds = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    seeds, seed_common = _sort_seeds(t, seeds, depth)
    seed_cut = np.searchsorted(t[seeds], np.arange(symbols + 1))

    queue = TupleQueue(symbols, in_memory)
    induce = _Inducer(queue, symbols, depth)
    found: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    final = TupleQueue(symbols, in_memory)
    # the last suffix is one symbol long: it is of type L and comes first of its symbol
    queue.push(int(t[-1]), np.array([n - 1]), np.array([0], np.uint8))
    induce.empty[t[-1]] = False
    for c in range(symbols):
        last = None
        while queue._held[c]:
            for block in queue.pop(c):
                p = block["p"]
                final.push(c, p, block["c"])
                last = int(p[-1])
                induce.take(block["c"], p, before[p], (p > 0) & (before[p] >= c))
        lo, hi = seed_cut[c], seed_cut[c + 1]
        if hi > lo:
            p, common = seeds[lo:hi], seed_common[lo:hi].copy()
            common[0] = 0 if last is None else min(run[last], run[p[0]], depth)
            induce.take(common, p, before[p], (p > 0) & (before[p] > c))
    queue.close()

    queue = TupleQueue(symbols, in_memory)
    induce = _Inducer(queue, symbols, depth)
    for c in range(symbols - 1, -1, -1):
        small: list[np.ndarray] = []  # S suffixes of c, descending, with the common prefix with the one taken before
        while queue._held[c]:
            for block in queue.pop(c):
                p = block["p"]
                small.append(block)
                induce.take(block["c"], p, before[p], (p > 0) & (before[p] <= c))
        large = [b for b in final.pop(c)]
        edge = 0
        if large:
            all_l = np.concatenate(large)
            p, common = all_l["p"][::-1], np.r_[all_l["c"][1:], np.uint8(0)][::-1].copy()
            if small:
                edge = min(run[int(small[-1]["p"][-1])], run[int(p[0])], depth)
            common[0] = edge
            induce.take(common, p, before[p], (p > 0) & (before[p] < c))
        else:
            all_l = np.empty(0, [("p", np.int64), ("c", np.uint8)])
        if small:
            all_s = np.concatenate(small)
            position = np.concatenate([all_l["p"], all_s["p"][::-1]])
            common = np.concatenate([all_l["c"], [np.uint8(edge)], all_s["c"][1:][::-1]])
        else:
            position, common = all_l["p"], all_l["c"]
        if len(position):
            yield position, common.astype(np.uint8)
    queue.close()
    final.close()
