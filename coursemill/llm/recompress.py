"""Removing word windows that stand earlier, by recompression.

Recompression names a token sequence in rounds. A run round gives each maximal run of one symbol a
name, a pair round splits the symbols into left and right ones and names each left one followed by a
right one. A name is a digest of what it stands for, so every task of a Spark job names alike, and
equal token strings get the same names except near their ends, where a neighbour outside may take part.

A window's *core* at a round is what no neighbour outside can change: its end runs go before a run round,
a right symbol at its start and a left one at its end before a pair round. What goes, in order, is the
window's sequence of names; equal windows have equal sequences. The symbol with which the core ends, of
four to five words usually, is its *anchor*, and adjacent windows share one.

1. Chunks of documents send their distinct anchors to buckets, which answer with those that occur at
   several places anywhere. All other windows have no equal.
2. Chunks send the remaining windows, each distinct one once: the digest of its sequence of names, a second
   digest of its words that shares nothing with the first, and its first document in the chunk. Buckets
   verify both and answer which windows an earlier document of another chunk has.
3. Chunks remove the words of these, and of all windows that repeat one within the chunk.

Answers are one bit for each entry sent, as a chunk finds the same entries in the same order again. The
texts are shuffled once: all three visits to the chunks read the same exchange. A passage in a third of all
documents is one entry per chunk, whatever the number of its occurrences. A long document is named
in blocks of words that overlap by a window; where a block ends changes no window's core.

Windows count as equal if 96 bits of two independent digests agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursemill.llm.repeats import packed_hashes, unpacked_hashes

WINDOW = 20
#: Bytes of text for each chunk and bucket.
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: Words that are named at a time.
BLOCK = 1 << 17
#: A run round comes first and then after so many pair rounds each time.
PAIR_ROUNDS = 4
#: Words of more bytes are hashed one by one.
LONG_WORD = 256

_U = np.uint64
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_FIRST, _SECOND = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)), (_U(0xC2B2AE3D27D4EB4F), _U(0xA0761D6478BD642F))
_BASE = _U(0x8CB92BA72F3D8DD7)


def _mixed(h: np.ndarray, by: tuple[np.uint64, np.uint64] = _FIRST) -> np.ndarray:
    h = h * by[0]
    h ^= h >> _U(32)
    h *= by[1]
    h ^= h >> _U(29)
    return h


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of ``a`` followed by ``b``."""
    return _mixed(_mixed(a) ^ (b + _FIRST[0]))


class Words:
    """The words of texts as byte ranges and two independent digests each."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(b"\n".join([*texts, b"\0" * 8]), dtype=np.uint8)
        self.size = int(offsets[-1])
        data = self.data[: self.size]
        inside = np.zeros(self.size + 2, dtype=np.int8)
        inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
        turns = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        #: first word of each text, and the number of words at last
        self.cuts = np.searchsorted(self.starts, offsets)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        lanes = np.ndarray((max(self.size, 1),), dtype="<u8", buffer=self.data, strides=(1,))
        length = self.ends - self.starts
        lane = lanes[self.starts] & _MASKS[np.minimum(length, 8)]
        sizes = length.astype(np.uint64)
        first, second = _joined(sizes, lane), _mixed(_mixed(lane ^ _SECOND[1], _SECOND) + sizes, _SECOND)
        rest = np.flatnonzero(length > 8)
        at = 8
        while len(rest) and at < LONG_WORD:
            lane = lanes[self.starts[rest] + at] & _MASKS[np.minimum(length[rest] - at, 8)]
            first[rest] = _joined(first[rest], lane)
            second[rest] = _mixed(second[rest] ^ _mixed(lane + _SECOND[0], _SECOND), _SECOND)
            at += 8
            rest = rest[length[rest] > at]
        for i in rest.tolist():
            digest = hashlib.blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=16).digest()
            first[i], second[i] = np.frombuffer(digest, "<u8")
        return first, second


def rounds_of(symbols: np.ndarray, fresh: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, symbols, first word of each, extra, number of each in the next round) without end.

    ``fresh`` marks the first symbol of each text; nothing is named across texts. ``extra`` are the bounds of
    the runs, or whether a symbol is a right one. A last place is the number of words.
    """
    place = np.arange(len(symbols) + 1, dtype=np.int32)
    turn = 0
    while True:
        if turn % (PAIR_ROUNDS + 1) == 0:
            begins = fresh.copy()
            begins[1:] |= symbols[1:] != symbols[:-1]
            number = np.cumsum(begins, dtype=np.int32) - np.int32(1)
            heads = np.flatnonzero(begins)
            bounds = np.append(heads, len(symbols)).astype(np.int32)
            yield "run", symbols, place, bounds, number
            count = np.diff(bounds)
            named = symbols[heads]
            several = np.flatnonzero(count > 1)
            named[several] = _joined(named[several], count[several].astype(np.uint64))
        else:
            right = (_mixed(symbols + _U(turn), _SECOND) >> _U(63)).astype(bool)
            second = np.zeros(len(symbols), dtype=bool)  # of a pair
            second[1:] = right[1:] & ~right[:-1] & ~fresh[1:]
            number = np.cumsum(~second, dtype=np.int32) - np.int32(1)
            yield "pair", symbols, place, right, number
            heads = np.flatnonzero(~second)
            named = symbols[heads]
            taken = np.flatnonzero(second)
            named[number[taken]] = _joined(named[number[taken]], symbols[taken])
        symbols, place, fresh = named, np.append(place[heads], place[-1]), fresh[heads]
        turn += 1


def named_windows(symbols: np.ndarray, fresh: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest of the sequence of names, anchor, the anchor's first word) of the windows from ``starts``."""
    n = len(starts)
    name, anchor, anchored = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int32)
    live, told = np.arange(n), np.full(n, _U(window))
    left, last = starts.astype(np.int32), (starts + (window - 1)).astype(np.int32)  # the core's ends
    for kind, symbols, place, extra, number in rounds_of(symbols, fresh):
        if not len(live):
            break
        if kind == "run":
            low, high = number[left], number[last]
            head = _joined(symbols[left], (np.minimum(extra[low + 1], last + 1) - left).astype(np.uint64))
            tail = _joined(symbols[last], (last + 1 - np.maximum(extra[high], left)).astype(np.uint64))
            told = _joined(told, head)
            told = np.where(high > low, _joined(told, tail), told)
            over = high - low < 2
            chosen, found = left, head
            low, high = low + 1, high - 1
        else:
            opens, closes = extra[left], ~extra[last]  # what a neighbour outside may take
            closes &= ~(opens & (left == last))
            told = _joined(told, np.where(opens, symbols[left], _U(1)))
            told = _joined(told, np.where(closes, symbols[last], _U(2)))
            low, high = left + opens, last - closes
            over = low > high
            heavier = place[last + 1] - place[last] > place[left + 1] - place[left]
            chosen = np.where(heavier, last, left)
            found = symbols[chosen]
            low, high = number[np.minimum(low, len(number) - 1)], number[high]
        done = live[over]
        name[done], anchor[done], anchored[done] = told[over], found[over], place[chosen[over]]
        stay = ~over
        live, told, left, last = live[stay], told[stay], low[stay], high[stay]
    return name, anchor, anchored


class Chunk:
    """Documents of a chunk in order, with their words; rows without doc_id neither give nor take."""

    def __init__(self, table: pa.Table, window: int):
        self.table = table.sort_by([("doc_id", "ascending"), ("_row", "ascending")])  # nulls last
        ids = self.table["doc_id"]
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.docs = ids.fill_null(0).to_numpy()
        self.words = Words([t.encode() for t in self.table["text"].to_pylist()])
        self.first, self.second = self.words.digests()
        self.window = window
        cuts = self.words.cuts
        count = np.diff(cuts)
        self.doc_of = np.repeat(np.arange(len(count), dtype=np.int32), count)
        self.fresh = np.zeros(len(self.first), dtype=bool)
        self.fresh[cuts[:-1][count > 0]] = True
        size = np.where(known, np.maximum(count - window + 1, 0), 0)
        self.starts = np.repeat(cuts[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def named(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digest of names, anchor and the anchor's first word of all windows, named block by block."""
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for begin in range(0, len(self.first), BLOCK):
            end = min(begin + BLOCK + self.window - 1, len(self.first))
            low, high = np.searchsorted(self.starts, [begin, begin + BLOCK])
            if high > low:
                fresh = self.fresh[begin:end].copy()
                fresh[0] = True
                name, anchor, place = named_windows(self.first[begin:end], fresh, self.starts[low:high] - begin, self.window)
                parts.append((name, anchor << _U(1), place.astype(np.int64) + begin))
        return tuple(np.concatenate(x) for x in zip(*parts))

    @staticmethod
    def anchors(anchor: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Distinct anchors in order, with the low bit set on those with several places in the chunk."""
        if not len(anchor):
            return anchor
        turn = np.ones(len(anchor), dtype=bool)  # adjacent windows mostly share one
        turn[1:] = (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1])
        anchor, place = anchor[turn], place[turn]
        order = np.argsort(anchor, kind="stable")
        anchor, place = anchor[order], place[order]
        at = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        several = np.minimum.reduceat(place, at) != np.maximum.reduceat(place, at)
        return anchor[at] | several.astype(np.uint64)

    def candidates(self, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, digest of names, second digest, number among the distinct ones) of windows with a shared anchor.

        In order of the digests; equal ones in order of their first words.
        """
        name, anchor, place = self.named()
        found = self.anchors(anchor, place)
        keep = _among(anchor, found[_answered(found, answers, 1, buckets)] & ~_U(1))
        start, name = self.starts[keep], name[keep]
        check = self.checks(start)
        order = np.lexsort((check, name))
        start, name, check = start[order], name[order], check[order]
        fresh = np.ones(len(start), dtype=bool)
        fresh[1:] = (name[1:] != name[:-1]) | (check[1:] != check[:-1])
        return start, name, check, np.cumsum(fresh) - 1

    def checks(self, start: np.ndarray) -> np.ndarray:
        """A polynomial of the second digests of each window's words."""
        total = np.zeros(len(start), np.uint64)
        for i in range(self.window):
            total = total * _BASE + self.second[start + i]
        return (_mixed(total, _SECOND) >> _U(32)).astype(np.uint32)

    def without(self, removed: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(kept words joined by a space, words, removed words) of each text, without the windows from ``removed``."""
        n = len(self.first)
        depth = np.zeros(n + 1, dtype=np.int64)
        depth[removed] += 1  # a window starts and ends once at a place
        depth[removed + self.window] -= 1
        gone = np.cumsum(depth[:-1]) > 0
        words = self.words
        keep = ~gone
        # each kept word's bytes and the separator behind it, which becomes a space
        edge = np.zeros(words.size + 1, dtype=np.int8)
        edge[words.starts[keep]] = 1
        edge[words.ends[keep] + 1] -= 1
        mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
        data = words.data[: words.size].copy()
        data[words.ends[keep]] = 32
        raw = data[mask].tobytes()
        size = np.concatenate([[0], np.cumsum((words.ends - words.starts + 1) * keep)])[words.cuts]
        texts = [raw[a : max(b - 1, a)].decode() for a, b in zip(size[:-1].tolist(), size[1:].tolist())]
        total = np.concatenate([[0], np.cumsum(gone)])[words.cuts]
        return texts, np.diff(words.cuts), np.diff(total)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _parts(values: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ordered 64-bit values, by equal ranges, without empty ones."""
    cuts = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)
    bounds = [0, *np.searchsorted(values, cuts).tolist(), len(values)]
    return [(b, x, y) for b, (x, y) in enumerate(zip(bounds, bounds[1:])) if y > x]


def _bits(blob: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=count).astype(bool)


ANCHORS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("names", pa.binary())])
WINDOWS = pa.schema([*ANCHORS, *[(c, pa.binary()) for c in ("checks", "owners", "ids")]])
ANSWERS = pa.schema([("_chunk", pa.int64()), ("visit", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])
_DDL = {pa.int64(): "long", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def shared_anchors(table: pa.Table) -> pa.Table:
    """For each chunk's anchors in a bucket, whether they occur at several places."""
    sent = [unpacked_hashes(b) for b in table["names"].to_pylist()]
    together = np.sort(np.concatenate(sent))
    plain = together & ~_U(1)
    shared = np.unique(np.concatenate([plain[1:][plain[1:] == plain[:-1]], plain[(together & _U(1)) == 1]]))
    bits = [np.packbits(_among(s & ~_U(1), shared)).tobytes() for s in sent]
    return pa.Table.from_arrays([table["chunk"], pa.array([1] * len(sent), pa.int64()), table["bucket"], pa.array(bits, pa.binary())], schema=ANSWERS)


def earlier_windows(table: pa.Table) -> pa.Table:
    """For each chunk's windows in a bucket, whether another chunk has them in an earlier document.

    Documents are in order of doc_id; where chunks share one, of the chunk.
    """
    names = [unpacked_hashes(b) for b in table["names"].to_pylist()]
    checks = [np.frombuffer(b, np.uint32) for b in table["checks"].to_pylist()]
    ids = [np.frombuffer(i, np.int64)[np.frombuffer(o, np.uint32)] for i, o in zip(table["ids"].to_pylist(), table["owners"].to_pylist())]
    sizes = [len(x) for x in names]
    chunk = np.repeat(table["chunk"].to_numpy(), sizes)
    name, check, doc = (np.concatenate(x) for x in (names, checks, ids))
    order = np.lexsort((chunk, doc, check, name))
    name, check = name[order], check[order]
    late = np.zeros(len(order), dtype=bool)
    late[order[1:]] = (name[1:] == name[:-1]) & (check[1:] == check[:-1])
    bits = [np.packbits(x).tobytes() for x in np.split(late, np.cumsum(sizes)[:-1])]
    return pa.Table.from_arrays([table["chunk"], pa.array([2] * len(sizes), pa.int64()), table["bucket"], pa.array(bits, pa.binary())], schema=ANSWERS)


def _answered(entries: np.ndarray, answers: pa.Table, visit: int, buckets: int) -> np.ndarray:
    """One answer for each entry of a chunk."""
    said = {r["bucket"]: r["bits"] for r in answers.to_pylist() if r["visit"] == visit}
    out = np.zeros(len(entries), dtype=bool)
    for bucket, x, y in _parts(entries, buckets):
        out[x:y] = _bits(said[bucket], y - x)
    return out


def without_repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text, ``rest`` (a struct of all other columns), n_words and n_removed of each row.

    Words are runs of anything but ASCII white space. A word goes if a window of ``window`` words over it also
    starts earlier: in a document with a smaller doc_id, or before in its own. Windows are judged on the input.
    ``text`` is the words that stay, joined by a space.

    Null texts are empty. Rows without doc_id lose nothing and cause no removal. Rows that share a doc_id
    are different documents, in an order that follows from digests of their texts; of equal rows one is
    the first. Texts shorter than a window stay whole. An empty table gives an empty result.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = (max(1, ceil(size / b)) for b in (CHUNK_BYTES, BUCKET_BYTES))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    held = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.struct(*(others or [F.lit(0).alias("none")])).alias("rest"),
    )
    held = held.withColumn("_row", F.xxhash64("doc_id", "text")).withColumn("_chunk", F.pmod("_row", F.lit(chunks)))
    grouped = held.groupBy("_chunk")

    def number(table: pa.Table) -> int:
        return table["_chunk"][0].as_py()

    def anchors(table: pa.Table) -> pa.Table:
        found = Chunk.anchors(*Chunk(table, window).named()[1:])
        rows = [{"bucket": b, "chunk": number(table), "names": packed_hashes(found[x:y])} for b, x, y in _parts(found, buckets)]
        return pa.Table.from_pylist(rows, ANCHORS)

    def windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return WINDOWS.empty_table()
        chunk = Chunk(table, window)
        start, name, check, _ = _distinct(*chunk.candidates(answers, buckets))
        rows = []
        for b, x, y in _parts(name, buckets):
            owners, place = np.unique(chunk.doc_of[start[x:y]], return_inverse=True)
            row = {"bucket": b, "chunk": number(table), "names": packed_hashes(name[x:y]), "checks": check[x:y].tobytes()}
            rows.append(row | {"owners": place.astype(np.uint32).tobytes(), "ids": chunk.docs[owners].tobytes()})
        return pa.Table.from_pylist(rows, WINDOWS)

    kept_schema = T.StructType([*held.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.append_column("n_words", pa.array([], pa.int64())).append_column("n_removed", pa.array([], pa.int64()))
        chunk = Chunk(table, window)
        removed = np.zeros(0, np.int64)
        if answers.num_rows:
            start, name, check, entry = chunk.candidates(answers, buckets)
            if len(start):
                late = _answered(_distinct(start, name, check, entry)[1], answers, 2, buckets)
                again = np.append(False, entry[1:] == entry[:-1])
                removed = start[late[entry] | again]
        texts, words, gone = chunk.without(removed)
        out = chunk.table
        column = out.schema.get_field_index("text")
        out = out.set_column(column, "text", pa.array(texts, out.schema.field("text").type))
        return out.append_column("n_words", pa.array(words, pa.int64())).append_column("n_removed", pa.array(gone, pa.int64()))

    sent = grouped.applyInArrow(anchors, _ddl(ANCHORS))
    first = sent.groupBy("bucket").applyInArrow(shared_anchors, _ddl(ANSWERS))
    entries = grouped.cogroup(first.groupBy("_chunk")).applyInArrow(windows, _ddl(WINDOWS))
    second = entries.groupBy("bucket").applyInArrow(earlier_windows, _ddl(ANSWERS))
    answers = first.unionByName(second)
    return grouped.cogroup(answers.groupBy("_chunk")).applyInArrow(cut, kept_schema).drop("_row", "_chunk")


def _distinct(start: np.ndarray, name: np.ndarray, check: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first window of each entry."""
    at = np.flatnonzero(np.append(True, entry[1:] != entry[:-1])) if len(entry) else np.zeros(0, np.int64)
    return start[at], name[at], check[at], entry[at]
