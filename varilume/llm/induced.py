"""Suffix sorting by induction, with queues that go to disk and common-prefix values carried along."""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of queued tuples kept in memory; what is more goes to files of the task, gone when it ends.
MEMORY = 64 << 20
_PAIR = np.dtype([("at", np.int32), ("lcp", np.int32)])


class Queues:
    """A monotone priority queue: a first-in first-out queue for each symbol, spilled to disk beyond a budget.

    Suffixes arrive in rank order, so the order of arrival within a symbol is the order of their ranks.
    """

    def __init__(self, symbols: int, memory: int = MEMORY):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.files: dict[int, object] = {}
        self.memory, self.held = memory, 0

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        part = np.empty(len(at), _PAIR)
        part["at"], part["lcp"] = at, lcp
        self.parts[symbol].append(part)
        self.held += part.nbytes
        if self.held > self.memory:
            for s, parts in enumerate(self.parts):
                if parts:
                    f = self.files.setdefault(s, tempfile.TemporaryFile())  # noqa: SIM115
                    f.seek(0, 2)
                    for p in parts:
                        f.write(p.tobytes())
                    self.parts[s] = []
            self.held = 0

    def pop(self, symbol: int) -> np.ndarray:
        """All that has arrived for the symbol and hasn't been popped."""
        parts = self.parts[symbol]
        self.parts[symbol] = []
        self.held -= sum(p.nbytes for p in parts)
        if f := self.files.pop(symbol, None):
            f.seek(0)
            parts = [np.frombuffer(f.read(), _PAIR), *parts]
            f.close()
        return np.concatenate(parts) if parts else np.empty(0, _PAIR)


class _Scan:
    """One direction of the induction: what is read in order pushes its predecessors of the wanted type."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, symbols: int, cap: int, memory: int):
        self.text, self.wanted, self.cap = text, wanted, cap
        self.queues = Queues(symbols, memory)
        self.least = np.full(symbols, -1, np.int32)  # least common prefix since a symbol's last push; -1: none yet

    def read(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """lcp: with what was read before, the first of all included."""
        if not len(at):
            return
        pred = at - 1
        ok = np.flatnonzero((at > 0) & self.wanted[pred])
        low = int(lcp.min())
        if not len(ok):
            np.minimum(self.least, low, out=self.least, where=self.least >= 0)
            return
        symbols = self.text[pred[ok]]
        order = np.argsort(symbols, kind="stable")
        ranked = symbols[order]
        cuts = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
        pushed = {}
        for idx in np.split(order, cuts):
            q = ok[idx]
            c = int(symbols[idx[0]])
            # least value in (previous push, this push]
            edges = np.concatenate(([0], q[:-1] + 1)).astype(np.intp)
            value = np.minimum.reduceat(lcp[: q[-1] + 1], edges)
            first = self.least[c]
            value = value + 1
            value[0] = 0 if first < 0 else min(int(first), int(value[0]) - 1) + 1
            self.queues.push(c, pred[q], np.minimum(value, self.cap))
            pushed[c] = int(lcp[q[-1] + 1 :].min()) if q[-1] + 1 < len(lcp) else self.cap
        np.minimum(self.least, low, out=self.least, where=self.least >= 0)
        for c, v in pushed.items():
            self.least[c] = v


def types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is of type S, length of the run of equal symbols from here); the last symbol is the least and of type S."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    nxt = np.append(change + 1, n)
    run_end = nxt[np.searchsorted(change, np.arange(n))]
    s = np.ones(n, bool)
    inner = run_end < n
    s[inner] = text[run_end[inner]] > text[inner]
    return s, (run_end - np.arange(n)).astype(np.int32)


def induce(text: np.ndarray, s_type: np.ndarray, run: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, cap: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, with each one's common prefix with the one before, from the ordered S* suffixes.

    First the L suffixes in ascending order, then the S suffixes in descending order.
    """
    symbols = int(text.max()) + 1
    lefts: list[np.ndarray] = [np.empty(0, _PAIR)] * symbols
    scan = _Scan(text, ~s_type, symbols, cap, memory)
    bounds = np.searchsorted(text[seeds], np.arange(symbols + 1))
    for c in range(symbols):
        rounds = []
        while len(got := scan.queues.pop(c)):
            rounds.append(got)
            scan.read(got["at"], got["lcp"])
        lefts[c] = np.concatenate(rounds) if rounds else lefts[c]
        own = slice(bounds[c], bounds[c + 1])
        at, lcp = seeds[own], seed_lcp[own].copy()
        if len(at):
            lcp[0] = min(run[lefts[c]["at"][-1]], run[at[0]], cap) if len(lefts[c]) else 0
            scan.read(at, lcp)
    scan = _Scan(text, s_type, symbols, cap, memory)
    order, values = [], []
    # the last suffix is the least of all and of type S; nothing larger induces it
    for c in reversed(range(symbols)):
        rounds = []
        while len(got := scan.queues.pop(c)):
            rounds.append(got)
            scan.read(got["at"], got["lcp"])
        s = np.concatenate(rounds) if rounds else np.empty(0, _PAIR)
        if c == int(text[-1]):
            end = np.zeros(1, _PAIR)
            end["at"] = len(text) - 1
            s = np.concatenate((s, end))
        left = lefts[c]
        meet = min(int(run[left["at"][-1]]), int(run[s["at"][-1]]), cap) if len(left) and len(s) else 0
        if len(left):
            down = np.concatenate(([meet], left["lcp"][:0:-1])).astype(np.int32)
            scan.read(left["at"][::-1], down)
        # s came in descending order, each with its prefix shared with the next larger one
        up = np.concatenate(([meet], s["lcp"][:0:-1])).astype(np.int32) if len(s) else np.empty(0, np.int32)
        order.append(np.concatenate((left["at"], s["at"][::-1])))
        values.append(np.concatenate((left["lcp"], up)))
    return np.concatenate(order[::-1]), np.concatenate(values[::-1])


def _ranks(names: np.ndarray, cap: int) -> np.ndarray:
    """Rank of each suffix of the reduced string: pairs are renamed, twice as long each time, until all differ.

    A name stands for two symbols or more, so half as many names as the cap are enough.
    """
    n, step = len(names), 1
    rank = names.astype(np.int64)
    while True:
        pair = rank * (n + 2)
        pair[: n - step] += rank[step:] + 1
        order = np.argsort(pair, kind="stable")
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(pair[order]) != 0)))
        if new.max(initial=0) == n - 1 or step >= min(n, cap):
            return new
        rank, step = new, 2 * step


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    out, live, n = np.zeros(len(a), np.int32), np.arange(len(a)), len(text)
    for k in range(cap):
        x, y = a[live] + k, b[live] + k
        same = np.zeros(len(live), bool)
        ok = (x < n) & (y < n)
        same[ok] = text[x[ok]] == text[y[ok]]
        live = live[same]
        if not len(live):
            break
        out[live] += 1
    return out


def suffix_array(text: np.ndarray, cap: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix with the one before, at most cap) of symbols that end with a unique least one.

    Suffixes that share their first cap symbols may stand in any order.
    """
    s_type, run = types(text)
    star = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(star) > 1:
        # sort the S* substrings by inducing from S* suffixes in the order of their first symbols alone
        first = star[np.argsort(text[star], kind="stable")]
        rough, _ = induce(text, s_type, run, first, np.zeros(len(first), np.int32), cap, memory)
        is_star = np.zeros(len(text), bool)
        is_star[star] = True
        rough = rough[is_star[rough]]
        length = np.zeros(len(text), np.int64)
        length[star] = np.diff(np.append(star, len(text) - 1)) + 1
        new = np.ones(len(rough), bool)
        a, b = rough[:-1], rough[1:]
        same = length[a] == length[b]
        pairs = np.flatnonzero(same)
        for k in range(int(length[star].max(initial=0))):
            live = pairs[length[a[pairs]] > k]
            if not len(live):
                break
            differs = text[a[live] + k] != text[b[live] + k]
            same[live[differs]] = False
            pairs = live[~differs]
        new[1:] = ~same
        names = np.zeros(len(text), np.int64)
        names[rough] = np.cumsum(new)
        star = star[np.argsort(_ranks(names[star], cap), kind="stable")]
    lcp = np.zeros(len(star), np.int32)
    if len(star) > 1:
        lcp[1:] = _common(text, star[:-1], star[1:], cap)
    return induce(text, s_type, run, star.astype(np.int64), lcp, cap, memory)


def repeats(strings: list[bytes], length: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, group): every window of the length that occurs more than once; equal windows share a group."""
    sizes = np.array([len(s) for s in strings], np.int64)
    text = np.zeros(int(sizes.sum()) + len(strings) + 1, np.uint16)  # 16 bits sort by radix
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    joined = np.frombuffer(b"\0".join(strings), np.uint8)
    text[: len(joined)] = joined.astype(np.uint16) + 2
    text[begin + sizes] = 1
    order, lcp = suffix_array(text, length, memory)
    owner = np.searchsorted(begin, order, side="right") - 1
    fits = order + length <= begin[np.maximum(owner, 0)] + sizes[np.maximum(owner, 0)]
    # windows of one group stand together: a smaller common prefix starts the next
    group = np.cumsum(lcp < length)
    order, owner, group = order[fits], owner[fits], group[fits]
    n = np.bincount(group) if len(group) else np.zeros(1, np.int64)
    many = n[group] > 1
    order, owner, group = order[many], owner[many], group[many]
    return owner, order - begin[owner], group
