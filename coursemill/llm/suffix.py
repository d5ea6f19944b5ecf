"""External induced sorting of suffixes with their common-prefix lengths.

The scheme of Bingmann, Fischer and Osipov ("Inducing suffix and LCP arrays in external memory"):
the suffixes that start at a local valley (S*) are sorted first, by naming the strings between
valleys and, if names repeat, by the same method on the string of names. All other suffixes follow
by induction: scanning suffixes in order and handing each one's predecessor to a priority queue, once
upwards (L) and once downwards (S). Queue entries carry the suffix and its common prefix with the
entry pushed before it, which is one more than the least common prefix scanned in between.

At the level of bytes the queue is monotone: the priority of an entry is its first byte, then its
turn. It is therefore kept as 256 first-in first-out lists, whose entries are numpy blocks that go to
a file once their total exceeds ``memory`` bytes. Whole blocks are popped and pushed at a time. At
the levels of names, where the alphabet is large, a heap with sorted runs on disk serves single
tuples; names that fit in memory are ranked by prefix doubling instead, as the end of the recursion.

Common prefixes are exact up to ``cap`` and cut there.
"""

from __future__ import annotations

import heapq
import os
import struct
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 15
#: Names up to this number are ranked in memory.
IN_MEMORY_NAMES = 1 << 26
PAD = 64


class Store:
    """Blocks of (position, prefix) in memory up to a budget, and in one file beyond it."""

    def __init__(self, folder: str, memory: int, kind: type):
        self.memory, self.used, self.kind = memory, 0, np.dtype(kind)
        self.path = os.path.join(folder, f"blocks-{id(self)}")
        self.file = None

    def put(self, places: np.ndarray, prefixes: np.ndarray):
        size = places.nbytes + prefixes.nbytes
        if self.used + size <= self.memory:
            self.used += size
            return places, prefixes
        if self.file is None:
            self.file = open(self.path, "w+b")  # noqa: SIM115 - lives as long as the store
        at = self.file.seek(0, os.SEEK_END)
        self.file.write(places.tobytes() + prefixes.tobytes())
        return at, len(places)

    def get(self, handle) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(handle[0], np.ndarray):
            return handle
        at, count = handle
        self.file.seek(at)
        raw = self.file.read((self.kind.itemsize + 1) * count)
        return np.frombuffer(raw, self.kind, count), np.frombuffer(raw, np.uint8, count, self.kind.itemsize * count)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            os.unlink(self.path)


class Fifo:
    """The entries of one first byte, in the order they came."""

    def __init__(self, store: Store):
        self.store, self.handles, self.tail, self.waiting, self.read = store, [], [], 0, 0

    def push(self, places: np.ndarray, prefixes: np.ndarray) -> None:
        self.tail.append((places, prefixes))
        self.waiting += len(places)
        if self.waiting >= BLOCK:
            self.seal()

    def seal(self) -> None:
        if self.tail:
            places, prefixes = (np.concatenate(x) for x in zip(*self.tail))
            self.handles.append(self.store.put(places, prefixes))
            self.tail, self.waiting = [], 0

    def pop(self) -> tuple[np.ndarray, np.ndarray] | None:
        if self.read == len(self.handles):
            self.seal()
        if self.read == len(self.handles):
            return None
        self.read += 1
        return self.store.get(self.handles[self.read - 1])

    def backwards(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.seal()
        for handle in reversed(self.handles):
            places, prefixes = self.store.get(handle)
            yield places[::-1], prefixes[::-1]

    def forwards(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.seal()
        for handle in self.handles:
            yield self.store.get(handle)

    def end(self, last: bool) -> int | None:
        """The first or last position pushed."""
        self.seal()
        if not self.handles:
            return None
        return int(self.store.get(self.handles[-1 if last else 0])[0][-1 if last else 0])


def ascending(symbols: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one behind it (S); the last is not, as the end is smallest."""
    n = len(symbols)
    found = np.zeros(n, dtype=bool)
    carry = False
    for start in reversed(range(0, n - 1, 1 << 20)):
        end = min(n - 1, start + (1 << 20))
        here, behind = symbols[start:end], symbols[start + 1 : end + 1]
        differs = here != behind
        place = np.where(differs, np.arange(end - start), end - start)
        nearest = np.minimum.accumulate(place[::-1])[::-1]
        known = nearest < end - start
        part = np.full(end - start, carry)
        part[known] = (here < behind)[nearest[known]]
        found[start:end] = part
        carry = bool(part[0])
    return found


def common_prefix(padded: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix lengths of suffixes ``a`` and ``b`` of the first n bytes, up to ``cap``."""
    words = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    length = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    for offset in range(0, cap, 8):
        x = words[np.minimum(a[live] + offset, n)] ^ words[np.minimum(b[live] + offset, n)]
        low = x & (~x + np.uint64(1))
        first = np.where(x == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(float)).astype(np.int64) // 8)
        length[live] += first
        live = live[x == 0]
        if not len(live):
            break
    return np.minimum(length, np.minimum(cap, n - np.maximum(a, b)))


def names_of(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the strings from each S* start through the next one, and how many differ.

    Where one string is a prefix of another the longer one is smaller: at the shorter one's end the
    longer one still falls. Only the last string ends with the text, which is smaller than all.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.int64), 0
    lengths = np.append(np.diff(starts) + 1, len(symbols) - starts[-1])
    wide = 7 if symbols.dtype == np.uint8 else 1
    top, last = np.iinfo(symbols.dtype).max, len(starts) - 1

    def chunk(which: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
        left = np.minimum(lengths[which] - offset, wide + 1)
        key = np.zeros(len(which), dtype=np.uint64)
        for i in range(wide):
            at = np.minimum(starts[which] + offset + i, len(symbols) - 1)
            symbol = np.where(i < left, symbols[at], np.where(which == last, 0, top)).astype(np.uint64)
            key = (key << np.uint64(8 if wide == 7 else 0)) | symbol
        return key, np.where((which == last) & (left <= wide), 0, wide + 2 - left)

    def ranked(*keys: np.ndarray) -> np.ndarray:
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), dtype=np.int64)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(new)
        return rank

    everything = np.arange(len(starts))
    key, ended = chunk(everything, 0)
    if wide == 7:
        name = np.unique((key << np.uint64(8)) | ended.astype(np.uint64), return_inverse=True)[1].astype(np.int64)
    else:
        name = ranked(key, ended)
    active, offset = np.flatnonzero(lengths > wide), wide
    while len(active):
        key, ended = chunk(active, offset)
        sub = np.zeros(len(starts), dtype=np.int64)
        sub[active] = ranked(key, ended)
        name = ranked(name, sub)
        offset += wide
        active = active[lengths[active] > offset]
    return name, int(name.max()) + 1


def doubled(names: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``names`` by prefix doubling in memory; the end is smallest.

    A rank is the place of a group's first suffix, so suffixes that stand alone keep theirs and only
    groups of several are sorted again.
    """
    n = len(names)
    order = np.argsort(names)
    rank = np.zeros(n + 1, dtype=np.int64)  # the last is the end's

    def place(sorted_: np.ndarray, fresh: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Ranks for sorted suffixes whose groups begin where ``fresh``; returns those not alone."""
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(sorted_)))
        rank[sorted_] = np.repeat(base[first], size)
        return np.repeat(size > 1, size)

    line = names[order]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = line[1:] != line[:-1]
    several = place(order, fresh, np.arange(1, n + 1))
    at, step = np.flatnonzero(several), 1
    while len(at):
        members = order[at]
        own, behind = rank[members], rank[np.minimum(members + step, n)]
        by = np.argsort(own * (n + 2) + behind)
        members, own, behind = members[by], own[by], behind[by]
        order[at] = members  # groups keep their places: ``at`` and ``own`` rise together
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (own[1:] != own[:-1]) | (behind[1:] != behind[:-1])
        several = place(members, fresh, at + 1)
        at, step = at[several], step * 2
    return order


class DiskHeap:
    """A priority queue of integer triples: a heap of at most ``held`` of them, and sorted runs on disk."""

    RECORD = struct.Struct("<qqq")

    def __init__(self, folder: str, held: int):
        self.folder, self.held, self.heap, self.runs, self.files = folder, held, [], [], []

    def push(self, entry: tuple[int, int, int]) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.held:
            path = os.path.join(self.folder, f"run-{id(self)}-{len(self.files)}")
            with open(path, "wb") as out:
                for e in sorted(self.heap):
                    out.write(self.RECORD.pack(*e))
            self.heap = []
            run = self._read(path)
            heapq.heappush(self.runs, (next(run), len(self.files), run))
            self.files.append(path)

    def _read(self, path: str) -> Iterator[tuple[int, int, int]]:
        with open(path, "rb") as source:
            while raw := source.read(self.RECORD.size * 4096):
                yield from self.RECORD.iter_unpack(raw)

    def least(self) -> tuple[int, int, int] | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple[int, int, int]:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            entry, number, run = self.runs[0]
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, run))
            return entry
        return heapq.heappop(self.heap)

    def close(self) -> None:
        for path in self.files:
            os.unlink(path)


def induced_names(names: np.ndarray, folder: str, in_memory: int, held: int) -> np.ndarray:
    """Order of all suffixes of a string of names, by induction over tuples through disk heaps."""
    n = len(names)
    if n <= in_memory:
        return doubled(names)
    up = ascending(names)
    stars = sorted_stars(names, up, folder, in_memory, held)
    text = names  # one name at a time: items of a memory map or an array
    heap, turn, falling = DiskHeap(folder, held), 0, []
    heap.push((int(text[n - 1]), turn, n - 1))
    at = 0
    while True:
        top = heap.least()
        if top is None and at == len(stars):
            break
        if at == len(stars) or (top is not None and top[0] <= text[stars[at]]):
            place = heap.pop()[2]
            falling.append(place)
        else:
            place, at = int(stars[at]), at + 1
        if place and not up[place - 1]:
            turn += 1
            heap.push((int(text[place - 1]), turn, place - 1))
    heap.close()
    heap, turn, order = DiskHeap(folder, held), 0, np.empty(n, dtype=np.int64)
    write, at = n, len(falling) - 1
    while write:
        top = heap.least()
        if at < 0 or (top is not None and -top[0] >= text[falling[at]]):
            place = heap.pop()[2]
        else:
            place, at = falling[at], at - 1
        write -= 1
        order[write] = place
        if place and up[place - 1]:
            turn += 1
            heap.push((-int(text[place - 1]), turn, place - 1))
    heap.close()
    return order


def sorted_stars(symbols: np.ndarray, up: np.ndarray, folder: str, in_memory: int, held: int) -> np.ndarray:
    """S* positions in the order of their suffixes: by name if names differ, else by the order of the names' suffixes."""
    starts = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    names, kinds = names_of(symbols, starts)
    if kinds == len(starts):
        return starts[np.argsort(names)]
    return starts[induced_names(names, folder, in_memory, held)]


class _Prefixes:
    """The least prefix scanned since the last push to each byte's list."""

    def __init__(self, cap: int):
        self.cap = cap
        self.since = np.full(256, cap, dtype=np.uint8)
        self.fresh = np.ones(256, dtype=bool)

    def pushes(self, prefixes: np.ndarray, at: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, cuts, prefix) of pushes from the scanned places ``at``, stable by target byte.

        ``prefixes`` are those of the scanned block, each with the one scanned before it.
        """
        n = len(prefixes)
        table = [np.ascontiguousarray(prefixes)]  # table[k][i]: least of 2**k from i
        while (1 << len(table)) <= n:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        order = np.argsort(targets, kind="stable")
        t, j = targets[order], at[order]
        first = np.ones(len(t), dtype=bool)
        first[1:] = t[1:] != t[:-1]
        start = np.zeros(len(t), dtype=np.int64)
        start[1:] = j[:-1] + 1
        start[first] = 0

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Of prefixes[a .. b], b included."""
            level = np.frexp((b - a + 1).astype(float))[1] - 1
            out = np.empty(len(a), dtype=np.uint8)
            for k in np.unique(level):
                m = level == k
                out[m] = np.minimum(table[k][a[m]], table[k][b[m] - (1 << k) + 1])
            return out

        got = least(start, j) if len(t) else np.zeros(0, dtype=np.uint8)
        heads = t[first]
        got[first] = np.minimum(got[first], self.since[heads])
        got = np.minimum(got.astype(np.int64) + 1, self.cap).astype(np.uint8)
        got[np.flatnonzero(first)[self.fresh[heads]]] = 0
        # what remains behind the last push of each target
        self.since = np.minimum(self.since, table[-1].min() if n else self.cap)
        cuts = np.append(np.flatnonzero(first), len(t))
        ends = j[cuts[1:] - 1] + 1 if len(t) else np.zeros(0, dtype=np.int64)
        rest = np.full(len(heads), self.cap, dtype=np.uint8)
        inside = ends < n
        if inside.any():
            rest[inside] = least(ends[inside], np.full(int(inside.sum()), n - 1))
        self.since[heads] = rest
        self.fresh[heads] = False
        return order, cuts, got


def suffixes(
    text: np.ndarray, cap: int, folder: str, memory: int = 256 << 20, in_memory_names: int = IN_MEMORY_NAMES, held: int = 1 << 20
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (positions, common prefixes with the suffix before, up to ``cap``) of all suffixes in order.

    ``text`` is an array of bytes, in memory or mapped from a file. ``memory`` bounds the queues, not
    the text. An empty text has no blocks.
    """
    n = len(text)
    if not n:
        return
    padded = np.zeros(n + PAD, dtype=np.uint8)
    padded[:n] = text
    kind = np.int32 if n < 2**31 else np.int64
    stars = sorted_stars(text, ascending(text), folder, in_memory_names, held).astype(kind)
    star_prefix = np.zeros(len(stars), dtype=np.uint8)
    for s in range(1, len(stars), 1 << 18):
        e = min(len(stars), s + (1 << 18))
        star_prefix[s:e] = common_prefix(padded, n, stars[s - 1 : e - 1].astype(np.int64), stars[s:e].astype(np.int64), cap)
    star_cuts = np.searchsorted(text[stars], np.arange(257))
    store = Store(folder, memory, kind)

    def seam(a: int | None, b: int) -> int:
        if a is None or text[a] != text[b]:
            return 0
        return int(common_prefix(padded, n, np.array([a]), np.array([b]), cap)[0])

    def scan(places: np.ndarray, prefixes: np.ndarray, lists: list[Fifo], state: _Prefixes, wanted) -> None:
        before = padded[places - 1]  # position -1 is padding
        at = np.flatnonzero((places > 0) & wanted(before))
        targets = before[at]
        order, cuts, got = state.pushes(prefixes, at, targets)
        moved = places[at][order] - 1
        for a, b in zip(cuts, cuts[1:]):
            lists[targets[order[a]]].push(moved[a:b], got[a:b])

    falling = [Fifo(store) for _ in range(256)]
    state = _Prefixes(cap)
    falling[text[n - 1]].push(np.array([n - 1], dtype=kind), np.zeros(1, dtype=np.uint8))
    state.fresh[text[n - 1]] = False
    state.since[text[n - 1]] = 0  # the end of the text has nothing in common with what follows
    state.since[:] = 0
    for c in range(256):
        while (block := falling[c].pop()) is not None:
            scan(*block, falling, state, lambda b, c=c: b >= c)
        for s in range(star_cuts[c], star_cuts[c + 1], BLOCK):
            e = min(star_cuts[c + 1], s + BLOCK)
            prefixes = star_prefix[s:e].copy()
            if s == star_cuts[c]:
                prefixes[0] = seam(falling[c].end(last=True), int(stars[s]))
            scan(stars[s:e], prefixes, falling, state, lambda b, c=c: b > c)

    rising = [Fifo(store) for _ in range(256)]
    state = _Prefixes(cap)
    for c in reversed(range(256)):
        while (block := rising[c].pop()) is not None:
            scan(*block, rising, state, lambda b, c=c: b <= c)
        lowest, following = rising[c].end(last=True), None
        for places, prefixes in falling[c].backwards():
            with_higher = np.empty_like(prefixes)
            with_higher[1:] = prefixes[:-1]
            if following is not None:
                with_higher[0] = following
            else:
                with_higher[0] = seam(lowest, int(places[0])) if lowest is not None else 0
            following = prefixes[-1]
            scan(places, with_higher, rising, state, lambda b, c=c: b < c)

    for c in range(256):
        yield from falling[c].forwards()
        below = falling[c].end(last=True)
        blocks = rising[c].backwards()
        pending: tuple[np.ndarray, np.ndarray] | None = None
        first = True
        # an entry's prefix is the one with the next higher suffix, so each moves up by one
        carried = 0
        for places, prefixes in blocks:
            if first:
                carried, first = seam(below, int(places[0])), False
            moved = np.empty_like(prefixes)
            moved[0] = carried
            moved[1:] = prefixes[:-1]
            carried = int(prefixes[-1])
            if pending is not None:
                yield pending
            pending = (places, moved)
        if pending is not None:
            yield pending
    store.close()
