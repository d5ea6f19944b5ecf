import random

import numpy as np

from coursemill.llm import repeats


def brute(rows, length):
    """(n_bytes, n_removed, n_spans, kept) of each row, from a table of all windows."""
    first = {}
    for doc_id, text in rows:
        if doc_id is not None:
            raw = (text or "").encode()
            for p in range(len(raw) - length + 1):
                w = raw[p : p + length]
                first[w] = min(first.get(w, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if doc_id is not None and first[raw[p : p + length]] < doc_id:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def texts(rng):
    passage = "".join(rng.choice("abc dé") for _ in range(120))
    rows = []
    for i in range(40):
        body = "".join(rng.choice("abcdefgh iñ") for _ in range(rng.randint(0, 200)))
        if i % 3 == 0:
            cut = rng.randint(0, 60)
            body = body[: len(body) // 2] + passage[cut : cut + rng.randint(20, 80)] + body[len(body) // 2 :]
        rows.append((i * 3 % 41, body))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (7, rows[9][1]), (200, "ab" * 300), (201, "ab" * 100), (202, "a" * 500), (203, "a" * 400)]
    rows += [(300, None), (301, ""), (302, "x" * 49), (303, "x" * 49), (None, rows[6][1]), (50, rows[12][1]), (50, rows[12][1])]
    return rows


def test_against_all_windows(spark, monkeypatch):
    rows = texts(random.Random(2))
    docs = spark.createDataFrame([(*r, "lang", 1, 2) for r in rows], "doc_id long, text string, kept string, rest int, _row int")
    for bytes_ in (repeats.CHUNK_BYTES, 900):  # one chunk, bucket and shard, or many
        for name in ("CHUNK_BYTES", "BUCKET_BYTES", "SHARD_BYTES"):
            monkeypatch.setattr(repeats, name, bytes_)
        found = repeats.without_repeats(docs)
        got = found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "rest._row").collect()
        assert {r["_row"] for r in got} == {2}
        key = lambda r: (r[0] is None, r[0] or 0, r[4])
        assert sorted((tuple(r)[:4] + (bytes(r.kept),) for r in got), key=key) == sorted(brute(rows, 50), key=key)
    for r in found.select("text", "kept").collect():
        assert r.text == bytes(r.kept).decode("utf-8", "ignore")


def test_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packed_hashes_round_trip():
    import numpy as np

    values = np.array([0, 2, 2**40, 2**63 + 4, 2**64 - 2], dtype=np.uint64)
    assert repeats.unpacked_hashes(repeats.packed_hashes(values)).tolist() == values.tolist()


def test_shared_hashes_against_sets():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(30):
        sent = [np.unique(rng.integers(0, 40, rng.integers(1, 20)).astype(np.uint64)) * np.uint64(2) for _ in range(rng.integers(1, 5))]
        sent = [s | (rng.integers(0, 6, len(s)) == 0).astype(np.uint64) for s in sent]  # some are marked
        plain = [{int(h) & ~1 for h in s} for s in sent]
        wanted = {h for own in plain for h in own if sum(h in other for other in plain) > 1} | {int(h) - 1 for s in sent for h in s if h % 2}
        shared = repeats.shared_hashes(sent)
        assert shared.tolist() == sorted(wanted)
        for s, own in zip(sent, plain):
            assert repeats.held_hashes(s, shared).tolist() == sorted(own & wanted)
    assert repeats.held_hashes(np.array([2, 5], np.uint64), np.zeros(0, np.uint64)).tolist() == []


def test_small_numbers_take_few_bytes_on_the_way():
    import numpy as np
    import pyarrow as pa

    numbers = np.random.default_rng(1).integers(0, 1 << 16, 5000)
    blob = repeats.packed_numbers(numbers)
    assert repeats.unpacked_numbers(blob).tolist() == numbers.tolist()
    assert repeats.unpacked_numbers(repeats.packed_numbers(np.array([-1, 2**62, -(2**63)]))).tolist() == [-1, 2**62, -(2**63)]
    assert len(pa.compress(blob, "lz4", asbytes=True)) < 0.6 * len(pa.compress(numbers.astype(np.int64).tobytes(), "lz4", asbytes=True))
    data = np.frombuffer(np.random.default_rng(2).bytes(4000) + bytes(64), np.uint8)
    found = np.concatenate([least for least, *_ in repeats.runs_of(data, np.array([0, 4000]), 50, 20)])
    assert found.max() < 1 << 49 and not (found & np.uint64(1)).any()


def test_minimizers_are_sent_in_40_bits():
    data = np.frombuffer(random.Random(7).randbytes(20_000) + bytes(64), np.uint8)
    runs = list(repeats.runs_of(data, np.array([0, 20_000]), repeats.LENGTH, repeats.MINIMIZER))
    least = np.concatenate([r[0] for r in runs])
    assert (least >> np.uint64(41) == 0).all()  # the low bit is left for a mark
    assert len(np.unique(least)) > 1000
