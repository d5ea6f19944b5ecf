"""Best-fit packing of tokenised documents into fixed-length sequences.

Bounded-space online best-fit: a task holds a fixed number of open bins. Their free spaces are the
set bits of one integer, so the tightest bin that still takes a piece is the lowest set bit at or
above the piece's length. A piece that fits nowhere opens a bin; beyond the bound the fullest open
bin closes first.

Texts meet Python once, where they are tokenised, and leave it as one short row per piece. Only
those rows are shuffled, by (document, piece), so a very long document spreads over all tasks.
Each packing task reads its pieces longest first, which lets the short ones fill the gaps.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.session import materialise

SEQUENCE = 2048
OPEN_BINS = 8192
END_ID = 0
#: Tokens that one packing task is given: 8192 sequences' worth.
TASK_TOKENS = SEQUENCE * 8192
#: Chunks of text whose ids a Python worker remembers; later ones are encoded each time.
CACHED_CHUNKS = 400_000
#: Partition number and running number share a sequence_id.
PER_TASK = 1 << 36

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


class Encoder:
    """Ids of the byte-level BPE vocabulary as little-endian unsigned 32-bit numbers.

    The pattern never lets a token run from a character that isn't white space into white space.
    A text without white space before a blank can therefore be cut before each blank, and the ids
    of a cut piece depend on that piece alone: they are remembered. All other texts, and those
    with the end marker's own string, are encoded whole.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        ranks_file = vocabulary.removesuffix(".json") + ".tiktoken"
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.special = "<|endoftext|>"
        self.encoding = tiktoken.Encoding(
            "byte-bpe",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks=ranks,
            special_tokens={self.special: len(ranks)},
        )
        self.known: dict[str, bytes] = {}
        self.uncut = re.compile(r"\s ")

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        found = self.known.get(chunk)
        if found is None:
            found = self._pack(self.encoding.encode_ordinary(chunk))
            if len(self.known) < CACHED_CHUNKS:
                self.known[chunk] = found
        return found

    def __call__(self, text: str) -> bytes:
        if self.special in text or self.uncut.search(text):
            return self._pack(self.encoding.encode(text, allowed_special="all"))
        first, *rest = text.split(" ")
        known = self.known
        parts = [self._chunk(first)]
        for word in rest:
            chunk = " " + word
            parts.append(known.get(chunk) or self._chunk(chunk))
        return b"".join(parts)


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def piece_bounds(n: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, but for a shorter first."""
    count = max(1, ceil(n / sequence))
    first = n - (count - 1) * sequence
    return [(0, first), *((first + i * sequence, sequence) for i in range(count - 1))]


def tokenised(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length and the ids' checksum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text) + end
                for piece, (start, length) in enumerate(piece_bounds(len(ids) // 4, sequence)):
                    checksum = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    rows.append((doc_id, piece, start, length, checksum))
            made = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield made.assign(doc_id=made["doc_id"].astype("Int64"))

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInPandas(run, PIECES)


def best_fit(lengths: Iterable[int], capacity: int = SEQUENCE, open_bins: int = OPEN_BINS) -> list[tuple[int, int]]:
    """(bin, offset) of each length, in order, with at most ``open_bins`` bins open at a time."""
    free_bits, opened, bins, placed = 0, 0, {}, []
    made = 0
    for length in lengths:
        above = free_bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            stack = bins[free]
            number = stack.pop()
            if not stack:
                free_bits ^= 1 << free
            opened -= 1
        else:
            if opened >= open_bins:  # the fullest closes: the lowest set bit
                fullest = (free_bits & -free_bits).bit_length() - 1
                bins[fullest].pop()
                if not bins[fullest]:
                    free_bits ^= 1 << fullest
                opened -= 1
            number, free = made, capacity
            made += 1
        placed.append((number, capacity - free))
        left = free - length
        if left:
            bins.setdefault(left, []).append(number)
            free_bits |= 1 << left
            opened += 1
    return placed


def packed(pieces: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to written ``pieces``; task counts follow the token total."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        own = pd.concat(parts, ignore_index=True)
        places = np.array(best_fit(own["length"].tolist(), sequence, open_bins), dtype="int64")
        base = TaskContext.get().partitionId() * PER_TASK
        yield own.assign(sequence_id=places[:, 0] + base, offset=places[:, 1], doc_id=own["doc_id"].astype("Int64"))

    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, ceil(total / task_tokens))
    spread = pieces.repartition(tasks, F.xxhash64("doc_id", "piece")).sortWithinPartitions(
        F.desc("length"), "doc_id", "piece", "ids_crc32"
    )
    return spread.mapInPandas(run, PLACED)


def pack_documents(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """Packs every document of (doc_id, text), each followed by the end id.

    A null text is empty and still takes its end id. A null doc_id stays null; repeated rows are
    packed once each. Other columns are ignored. An empty table gives an empty result. The pieces
    are written to the shared folder, since their total decides how many tasks pack them.
    """
    return packed(materialise(tokenised(docs, vocabulary, sequence), "pieces"), sequence, open_bins)
