"""Removing byte strings that an earlier document has too, by external suffix sorting of shards.

Every window of ``length`` bytes must meet its equals, wherever they are, and most windows have none.

1. Each window is represented by its minimizer, the smallest hash of the k-byte strings in it; equal
   windows have equal minimizers. Runs of windows with one minimizer are the unit of work. Chunks of
   documents send their distinct minimizers, 40 bits each, to buckets; a bucket answers each chunk
   with those that more than one document has. This only leaves out windows without an equal.
2. Chunks send the remaining runs' bytes, each distinct one once, with the places it occurs at, to the
   shard of its minimizer. Equal windows thus meet in one shard.
3. A shard writes its distinct texts behind one another and sorts the suffixes with their common
   prefixes (see `suffix`), on disk where they exceed memory. Suffixes that share ``length`` bytes stand
   together; the smallest doc_id among their texts decides which of the other occurrences go.
4. The shards' answers, byte ranges per document, return to the chunks, which cut the texts.

The texts are shuffled once: all three visits to the chunks read the same exchange. A chunk, a bucket
and a shard hold a bounded share of the input each, and their numbers follow its size. A passage in a
third of all documents is one distinct text per chunk; a long document is processed in slices.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursemill.llm.suffix import suffixes

LENGTH = 50
#: Length of the strings that are hashed for minimizers.
MINIMIZER = 20
#: Longest run of windows that is sent as one text.
MOST_WINDOWS = 64
#: Bytes of input for each chunk, bucket and shard.
CHUNK_BYTES, BUCKET_BYTES, SHARD_BYTES = 4 << 20, 16 << 20, 4 << 20
SLICE = 1 << 18
#: Memory for the queues of a shard's suffix sort; more goes to disk.
SHARD_MEMORY = 64 << 20
#: Bits of a minimizer that is sent. Different ones that fall together only keep some windows without an equal: with 2^32 of them (some 60 GB) one in 256.
BITS = 40

_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    return h


def _minimizers(data: np.ndarray, start: int, count: int, length: int, k: int) -> np.ndarray:
    """The least hash of the k-byte strings in each of ``count`` windows from ``start``; data is padded."""
    n = count + length - k

    def word(offset: int) -> np.ndarray:
        return np.ndarray((n,), dtype="<u8", buffer=data, offset=start + offset, strides=(1,))

    h = _mix(word(0).copy())
    offset = 8
    while offset + 8 <= k:
        h = _mix(h ^ word(offset))
        offset += 8
    if offset < k:
        h = _mix(h ^ word(k - 8))
    width, step = length - k + 1, 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: count], h[width - step : width - step + count])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of (minimizer, document, first window, windows) of the runs; documents are data[offsets[i]:offsets[i+1]].

    The minimizer is mixed again, cut to ``BITS`` and doubled, which leaves a bit for a mark.
    """
    ends = offsets[1:] - length  # the last window of each document
    for start in range(0, int(offsets[-1]) - length + 1, SLICE):
        count = min(SLICE, int(offsets[-1]) - length + 1 - start)
        least = _minimizers(data, start, count, length, k)
        low = np.searchsorted(offsets, start, side="right") - 1
        high = np.searchsorted(offsets, start + count - 1, side="right") - 1
        own = np.arange(low, high + 1)
        own = own[ends[own] >= offsets[own]]
        first, last = np.maximum(offsets[own] - start, 0), np.minimum(ends[own] - start, count - 1)
        inside = last >= first
        own, first, last = own[inside], first[inside], last[inside]
        if not len(own):
            continue
        turn = np.zeros(count + 1, dtype=bool)
        turn[1:count] = least[1:] != least[:-1]
        turn[first] = True
        turn[last + 1] = True
        begin = np.flatnonzero(turn[:count])
        size = np.diff(np.append(begin, count))
        doc = np.searchsorted(first, begin, side="right") - 1
        valid = (doc >= 0) & (begin <= last[np.maximum(doc, 0)])
        begin, size, doc = begin[valid], size[valid], own[doc[valid]]
        parts = -(-size // MOST_WINDOWS)
        if parts.max(initial=1) > 1:
            part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin, size, doc = (np.repeat(x, parts) for x in (begin, size, doc))
            begin, size = begin + part * MOST_WINDOWS, np.minimum(size - part * MOST_WINDOWS, MOST_WINDOWS)
        yield (_mix(least[begin]) >> _U(64 - BITS)) << _U(1), doc, begin + start, size


def packed_hashes(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, byte plane by byte plane, which compresses well."""
    return np.diff(values, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_hashes(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def packed_numbers(values: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane: the planes of small numbers' high bytes compress to nothing."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<i8").ravel().astype(np.int64, copy=False)


class Chunk:
    """The documents of one chunk as bytes; rows without doc_id neither give nor take."""

    def __init__(self, table: pa.Table):
        self.table = table
        texts = table["text"].combine_chunks().cast(pa.large_binary())
        ids = table["doc_id"]
        self.known = ids.is_valid().to_numpy()
        self.docs = ids.fill_null(0).to_numpy()
        # numbers of the rows' hashes within the chunk: the same on each visit, and short to send
        self.rows = np.unique(table["_row"].to_numpy(), return_inverse=True)[1].astype(np.int64)
        raw = texts.buffers()
        self.offsets = np.frombuffer(raw[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].copy()
        size = int(self.offsets[-1] - self.offsets[0]) if len(texts) else 0
        self.data = np.zeros(size + 64, dtype=np.uint8)
        if size:
            self.data[:size] = np.frombuffer(raw[2], np.uint8)[self.offsets[0] : self.offsets[-1]]
        self.offsets -= self.offsets[0]

    def runs(self, length: int, k: int):
        for least, doc, begin, size in runs_of(self.data, self.offsets, length, k):
            known = self.known[doc]
            yield least[known], doc[known], begin[known], size[known]


def _joined(blobs, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype)


def _several(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The distinct hashes in order, with the low bit set on those of more than one id."""
    order = np.lexsort((ids, hashes))
    h, d = hashes[order], ids[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(h)) - 1
    return h[at] | (d[at] != d[last]).astype(np.uint64)


def shared_hashes(sent: list[np.ndarray]) -> np.ndarray:
    """The distinct hashes, in order and without marks, that several senders have or one has marked."""
    together = np.sort(np.concatenate(sent))
    plain = together & ~_U(1)
    # a hash's marked copies stand behind its others
    first = np.flatnonzero(np.append(True, plain[1:] != plain[:-1])[: len(plain)])
    last = np.append(first[1:], len(plain))[: len(first)] - 1
    return plain[first[(last > first) | ((together[last] & _U(1)) == 1)]]


def held_hashes(own: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Those of a sender's hashes, without marks, that are among the sorted ``shared``; a search each, as these are many times its own."""
    plain = own & ~_U(1)
    if not len(shared):
        return plain[:0]
    at = np.minimum(np.searchsorted(shared, plain), len(shared) - 1)
    return plain[shared[at] == plain]


OCCURRENCES = "shard long, chunk long, texts binary, sizes binary, times binary, ids binary, rows binary, starts binary"
#: Arrow's codec for the occurrences' texts.
TEXT_CODEC = "zstd"
SPANS = "chunk long, rows binary, starts binary, ends binary"


def covered(texts: list[bytes], least: np.ndarray, length: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest doc_id of each window, first window of each text) for distinct texts with their smallest doc_ids."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    whole = np.zeros(int(ends[-1]), dtype=np.uint8)
    for begin, text in zip(begins, texts):
        whole[begin : begin + len(text)] = np.frombuffer(text, np.uint8)
    none = np.iinfo(np.int64).max
    owner_cuts = begins
    found = np.full(len(whole), none, dtype=np.int64)

    def settle(places: np.ndarray, prefixes: np.ndarray) -> None:
        """Gives each suffix of a complete set of groups the least id of its group."""
        text = np.searchsorted(owner_cuts, places, side="right") - 1
        fits = places + length <= ends[text] - 1
        ids = np.where(fits, least[text], none)
        group = np.flatnonzero(prefixes < length)
        smallest = np.minimum.reduceat(ids, group)
        sizes_ = np.diff(np.append(group, len(places)))
        values = np.repeat(smallest, sizes_)
        found[places[fits]] = values[fits]

    held: list[tuple[np.ndarray, np.ndarray]] = []
    with tempfile.TemporaryDirectory() as folder:
        for places, prefixes in suffixes(whole, length, folder, memory):
            # a group may go on in the next block: what begins before the last beginning is complete
            cut = np.flatnonzero(prefixes < length)
            if len(cut) and held:
                a = int(cut[0])
                held.append((places[:a], prefixes[:a]))
                settle(*(np.concatenate(x) for x in zip(*held)))
                places, prefixes, held = places[a:], prefixes[a:], []
                cut = cut - a
            if len(cut) > 1:
                b = int(cut[-1])
                settle(places[:b], prefixes[:b])
                places, prefixes = places[b:], prefixes[b:]
            held.append((places, prefixes))
        if held:
            settle(*(np.concatenate(x) for x in zip(*held)))
    return found, begins


def _shard_spans(table: pa.Table, length: int, memory: int) -> pa.Table:
    """Byte ranges to remove, one row per chunk, from all occurrences sent to a shard."""
    place: dict[bytes, int] = {}
    texts: list[bytes] = []
    least: list[int] = []
    parts = []  # (chunk, text of each occurrence, ids, rows, starts)
    for row in table.to_pylist():
        sizes, times, ids, rows, starts = (unpacked_numbers(row[c]) for c in ("sizes", "times", "ids", "rows", "starts"))
        ids_least = np.minimum.reduceat(ids, np.cumsum(times) - times)
        blob, at, numbers = pa.decompress(row["texts"], int(sizes.sum()), TEXT_CODEC, asbytes=True), 0, []
        for size, first in zip(sizes.tolist(), ids_least.tolist()):
            text = blob[at : at + size]
            at += size
            number = place.get(text)
            if number is None:
                number = place[text] = len(texts)
                texts.append(text)
                least.append(first)
            elif first < least[number]:
                least[number] = first
            numbers.append(number)
        parts.append((row["chunk"], np.repeat(np.array(numbers, dtype=np.int64), times), ids, np.cumsum(rows), starts))
    smallest = np.array(least, dtype=np.int64)
    found, begins = covered(texts, smallest, length, memory)
    lengths = np.array([len(t) for t in texts])
    # windows of a text's own first document that a smaller one has: runs inside the text
    own = np.repeat(np.arange(len(texts), dtype=np.int32), lengths + 1)
    earlier = found < np.repeat(smallest, lengths + 1)
    turn = np.diff(np.concatenate([[False], earlier, [False]]).astype(np.int8))
    run_from, run_to = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    run_text = own[run_from] if len(run_from) else np.zeros(0, dtype=np.int64)
    cuts = np.searchsorted(run_text, np.arange(len(texts) + 1))
    out: dict[int, list] = {}
    for chunk, number, ids, rows, starts in parts:
        later = ids > smallest[number]
        pieces = [(rows[later], starts[later], starts[later] + lengths[number[later]])]
        firsts = np.flatnonzero(~later)
        count = cuts[number[firsts] + 1] - cuts[number[firsts]]
        which = np.repeat(firsts, count)
        run = np.repeat(cuts[number[firsts]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        base = starts[which] - begins[number[which]]
        pieces.append((rows[which], base + run_from[run], base + run_to[run] + length - 1))
        for piece in pieces:
            if len(piece[0]):
                out.setdefault(chunk, []).append(piece)
    rows_out = [
        {"chunk": chunk, **{name: np.concatenate([p[i] for p in pieces]).tobytes() for i, name in enumerate(("rows", "starts", "ends"))}}
        for chunk, pieces in sorted(out.items())
    ]
    return pa.Table.from_pylist(rows_out, pa.schema([("chunk", pa.int64()), ("rows", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())]))


def _cut(chunk: Chunk, spans: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(kept bytes, removed bytes, maximal removed runs) of each row."""
    rows, starts, ends = (_joined(spans[c].to_pylist(), np.int64) for c in ("rows", "starts", "ends"))
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order], ends[order]
    low, high = np.searchsorted(rows, chunk.rows, "left"), np.searchsorted(rows, chunk.rows, "right")
    kept, removed, count = [], np.zeros(len(chunk.rows), np.int64), np.zeros(len(chunk.rows), np.int64)
    raw = chunk.data.tobytes()
    for i, (a, b) in enumerate(zip(low, high)):
        begin, end = int(chunk.offsets[i]), int(chunk.offsets[i + 1])
        if a == b or not chunk.known[i]:
            kept.append(raw[begin:end])
            continue
        reach = np.maximum.accumulate(ends[a:b])
        fresh = np.flatnonzero(np.append(True, starts[a + 1 : b] > reach[:-1]))
        run_from = starts[a:b][fresh]
        run_to = reach[np.append(fresh[1:], b - a) - 1]
        parts, at = [], begin
        for x, y in zip(run_from.tolist(), run_to.tolist()):
            parts.append(raw[at : begin + x])
            at = begin + y
        parts.append(raw[at:end])
        kept.append(b"".join(parts))
        removed[i], count[i] = int((run_to - run_from).sum()), len(fresh)
    return kept, removed, count


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = MINIMIZER, memory: int = SHARD_MEMORY) -> DataFrame:
    """doc_id, text, ``rest`` (a struct of all other columns), kept (binary), n_bytes, n_removed and n_spans.

    ``text`` is what is kept, without the characters that a removal cut into; ``kept`` has all kept bytes.

    A byte goes if a ``length``-byte string over it also starts in a document with a smaller doc_id;
    strings are judged on the input. Null texts are empty. Rows without doc_id lose nothing and cause no
    removal. Rows of equal doc_id do not affect each other. An empty table gives an empty result.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets, shards = (max(1, ceil(size / b)) for b in (CHUNK_BYTES, BUCKET_BYTES, SHARD_BYTES))
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

    def minimizers(table: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        found = [(least, chunk.docs[doc]) for least, doc, _, _ in chunk.runs(length, k)]
        if not found:
            return pa.table({"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "hashes": pa.array([], pa.binary())})
        marked = _several(*(np.concatenate(x) for x in zip(*found)))
        cuts = [(i << (BITS + 1)) // buckets for i in range(1, buckets)]
        bounds = [0, *np.searchsorted(marked, np.array(cuts, dtype=np.uint64)).tolist(), len(marked)]
        full = [(b, x, y) for b, (x, y) in enumerate(zip(bounds, bounds[1:])) if y > x]
        return pa.table(
            {
                "bucket": pa.array([b for b, _, _ in full], pa.int64()),
                "chunk": pa.array([number(table)] * len(full), pa.int64()),
                "hashes": pa.array([packed_hashes(marked[x:y]) for _, x, y in full], pa.binary()),
            }
        )

    def answered(table: pa.Table) -> pa.Table:
        sent = [unpacked_hashes(b) for b in table["hashes"].to_pylist()]
        shared = shared_hashes(sent)
        replies = [held_hashes(s, shared) for s in sent]
        full = [i for i, r in enumerate(replies) if len(r)]
        numbers = table["chunk"].to_pylist()
        return pa.table(
            {"_chunk": pa.array([numbers[i] for i in full], pa.int64()), "hashes": pa.array([packed_hashes(replies[i]) for i in full], pa.binary())}
        )

    def occurrences(table: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in ("texts", "sizes", "times", "ids", "rows", "starts")]])
        if not table.num_rows or not replies.num_rows:
            return schema.empty_table()
        chunk = Chunk(table)
        shared = np.sort(np.concatenate([unpacked_hashes(b) for b in replies["hashes"].to_pylist()]))
        by_shard: dict[int, dict[bytes, list]] = {}
        raw = chunk.data.tobytes()
        for least, doc, begin, windows in chunk.runs(length, k):
            at = np.minimum(np.searchsorted(shared, least), len(shared) - 1)
            wanted = shared[at] == least
            shard = ((least[wanted] >> _U(1)) % _U(shards)).tolist()
            starts = begin[wanted]
            stops = (starts + windows[wanted] + length - 1).tolist()
            for s, d, a, b in zip(shard, doc[wanted].tolist(), starts.tolist(), stops):
                by_shard.setdefault(s, {}).setdefault(raw[a:b], []).append((d, a))
        out = []
        for shard, texts in sorted(by_shard.items()):
            flat = np.array([o for found in texts.values() for o in found], dtype=np.int64)
            times = np.array([len(found) for found in texts.values()], dtype=np.int64)
            out.append(
                {
                    "shard": shard,
                    "chunk": number(table),
                    "texts": pa.compress(b"".join(texts), TEXT_CODEC, asbytes=True),
                    "sizes": packed_numbers(np.array([len(t) for t in texts], dtype=np.int64)),
                    "times": packed_numbers(times),
                    "ids": packed_numbers(chunk.docs[flat[:, 0]]),
                    "rows": packed_numbers(np.diff(chunk.rows[flat[:, 0]], prepend=0)),
                    "starts": packed_numbers(flat[:, 1] - chunk.offsets[flat[:, 0]]),
                }
            )
        return pa.Table.from_pylist(out, schema)

    def spans(table: pa.Table) -> pa.Table:
        return _shard_spans(table, length, memory)

    added = [("kept", T.BinaryType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType())]
    kept_schema = T.StructType([*held.schema.fields, *[T.StructField(n, t) for n, t in added]])

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            for name, kind in zip(("kept", "n_bytes", "n_removed", "n_spans"), (pa.binary(), pa.int64(), pa.int64(), pa.int64())):
                table = table.append_column(name, pa.array([], kind))
            return table
        chunk = Chunk(table)
        kept, removed, count = _cut(chunk, found)
        texts = pa.array([k.decode("utf-8", "ignore") for k in kept], table.schema.field("text").type)
        return (
            table.set_column(table.schema.get_field_index("text"), "text", texts)
            .append_column("kept", pa.array(kept, pa.binary()))
            .append_column("n_bytes", pa.array(np.diff(chunk.offsets)))
            .append_column("n_removed", pa.array(removed))
            .append_column("n_spans", pa.array(count))
        )

    hashes = grouped.applyInArrow(minimizers, "bucket long, chunk long, hashes binary")
    replies = hashes.groupBy("bucket").applyInArrow(answered, "_chunk long, hashes binary")
    sent = grouped.cogroup(replies.groupBy("_chunk")).applyInArrow(occurrences, OCCURRENCES)
    found = sent.groupBy("shard").applyInArrow(spans, SPANS)
    result = grouped.cogroup(found.withColumnRenamed("chunk", "_chunk").groupBy("_chunk")).applyInArrow(cut, kept_schema)
    return result.drop("_row", "_chunk")
