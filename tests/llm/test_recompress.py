import random

import numpy as np
import pytest

from coursemill.llm import recompress
from coursemill.llm.op13 import op13


def brute(rows, window):
    """(doc_id, n_words, n_removed, text) of each row, from a table of all windows; ids differ."""
    import re

    cut = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first, out = {}, []
    for d in sorted(cut):
        gone = set()
        for i in range(len(cut[d]) - window + 1):
            if first.setdefault(tuple(cut[d][i : i + window]), (d, i)) != (d, i):
                gone |= set(range(i, i + window))
        out.append((d, len(cut[d]), len(gone), " ".join(w for i, w in enumerate(cut[d]) if i not in gone)))
    return out


def texts(rng, n=60):
    vocabulary = ["a", "b", "né", "word", "longerword", "x" * 9, "y" * 300, "y" * 299 + "z", "z z", "\x1c", "\U0001f600"]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    rows = []
    for i in range(n):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
        if i % 3 == 0:
            at, cut = len(body) // 2, rng.randint(0, 40)
            body[at:at] = passage[cut : cut + rng.randint(10, 60)]
        rows.append((i * 7 % 101, rng.choice([" ", "\n", "\t \x0b"]).join(body)))
    ids = {d for d, _ in rows}
    free = [d for d in range(300, 400) if d not in ids]
    rows += [(free.pop(), rows[4][1]), (free.pop(), rows[4][1]), (-5, rows[6][1]), (free.pop(), "a " * 200), (free.pop(), "a " * 55)]
    rows += [(free.pop(), "a b " * 100), (free.pop(), None), (free.pop(), ""), (free.pop(), " \n "), (free.pop(), " ".join(passage[:20]))]
    return rows


@pytest.mark.parametrize("window", [20, 3])
@pytest.mark.parametrize("small", [False, True])
def test_against_all_windows(spark, monkeypatch, window, small):
    rows = texts(random.Random(3))
    if small:  # many chunks, buckets and blocks
        monkeypatch.setattr(recompress, "CHUNK_BYTES", 2500)
        monkeypatch.setattr(recompress, "BUCKET_BYTES", 1700)
        monkeypatch.setattr(recompress, "BLOCK", 64)
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, _row int, n_words int, `a.b` string")
    found = recompress.without_repeated_windows(docs, window)
    got = sorted(tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "text").collect())
    assert got == brute(rows, window)
    assert {tuple(r) for r in found.select("rest._row", "rest.n_words", "rest.`a.b`").collect()} == {(1, 2, "x")}


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, text), (4, text), (4, text), (4, text + " more"), (9, text)]
    found = recompress.without_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in found.collect())
    assert [g for g in got if g[0]] == [(True, 0, 30, 0)] * 2  # lose nothing
    four = [g for g in got if g[1] == 4]
    assert sum(g[3] for g in four) == 60 and [g for g in got if g[1] == 9] == [(False, 9, 30, 30)]


def test_empty_table(spark):
    assert recompress.without_repeated_windows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(recompress, "BLOCK", 5000)
    rng = random.Random(5)
    body = [f"w{rng.randint(0, 3000)}" for _ in range(40_000)]
    body[30_000:30_100] = body[100:200]
    body[39_000:39_030] = ["same"] * 30
    rows = [(1, " ".join(body)), (2, " ".join(body[20_000:39_010])), (3, "word" * 500_000)]
    found = recompress.without_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "text").collect()) == brute(rows, 20)


def test_equal_strings_share_interior_names():
    rng = np.random.default_rng(1)
    inner = rng.integers(0, 50, 60).astype(np.uint64)
    names = []
    for _ in range(2):
        text = np.concatenate([rng.integers(0, 50, 40).astype(np.uint64), inner, rng.integers(0, 50, 40).astype(np.uint64)])
        fresh = np.zeros(len(text), dtype=bool)
        fresh[0] = True
        for turn, (_, symbols, place, _, _) in enumerate(recompress.rounds_of(text, fresh)):
            if turn == 5:
                inside = (place[:-1] >= 40) & (place[1:] <= 100)
                names.append(list(zip(symbols[inside].tolist(), place[:-1][inside].tolist())))
                break
    shared = set(names[0]) & set(names[1])
    assert len(shared) >= len(names[0]) - 6


def test_words_and_digests():
    words = recompress.Words([b"a bb  a\tbb", b"", b"x" * 300 + b" " + b"x" * 300 + b" " + b"x" * 299])
    first, second = words.digests()
    assert words.cuts.tolist() == [0, 4, 4, 7]
    for d in (first, second):
        assert d[0] == d[2] and d[1] == d[3] and d[0] != d[1] and d[4] == d[5] != d[6]


def test_query_reads_whole_table(spark, tmp_path):
    rows = texts(random.Random(8), 30)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op13(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(tuple(r)[:3] for r in got.collect()) == [b[:3] for b in brute(rows, 20)]
