import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from coursemill.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "\n", "plain words, and more.", " lead", "trail ", "two  blanks", "tab\tand \n lines\n\n\nend \n",
    "don't they'll I'm", "naïve Straße ñandú 漢字 😀 é", "<|endoftext|> in <|endoftext|>text", "12345 6,7 %%% &&& ###",
    "nb space  wide", "a\x1c b", "\x00 nul \x00", "a" * 3000,
]


def test_ids_are_those_of_the_tokenizer():
    reference = Tokenizer.from_file(VOCABULARY)
    encode = packing.encoder(VOCABULARY)
    for text in TEXTS:
        expected = np.array(reference.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encode(text) == expected, text


def test_best_fit_places_without_overlap_and_bounds_open_bins():
    rng = random.Random(1)
    for bins in (1, 3, 1000):
        lengths = [rng.randint(1, 50) for _ in range(300)]
        placed = packing.best_fit(lengths, 50, bins)
        ends: dict[int, int] = {}
        for (number, offset), length in zip(placed, lengths):
            assert offset == ends.get(number, 0)
            ends[number] = offset + length
            assert ends[number] <= 50
    # tightest bin wins; the fullest closes first
    assert packing.best_fit([30, 40, 10, 20], 50, 10) == [(0, 0), (1, 0), (1, 40), (0, 30)]
    assert packing.best_fit([30, 40, 45, 10], 50, 2) == [(0, 0), (1, 0), (2, 0), (0, 30)]


def test_piece_bounds():
    assert packing.piece_bounds(5, 4) == [(0, 1), (1, 4)]
    assert packing.piece_bounds(8, 4) == [(0, 4), (4, 4)]
    assert packing.piece_bounds(1, 4) == [(0, 1)]


def test_every_document_is_packed_whole(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1), (3, None, None, None), (4, TEXTS[4], "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, offset int")
    got = packing.pack_documents(docs, VOCABULARY, sequence=64).collect()
    reference = Tokenizer.from_file(VOCABULARY)
    expected = []
    for doc_id, text, *_ in rows:
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for piece, (start, length) in enumerate(packing.piece_bounds(len(ids), 64)):
            expected.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, expected))
    ends: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 64 and len(ends) <= sum(ends.values()) / 64 + 2
    assert packing.pack_documents(docs.limit(0), VOCABULARY).count() == 0
