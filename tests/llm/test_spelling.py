import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from coursemill.llm import fmindex, spelling
from coursemill.llm.fmindex import BothWays, OneWay, alphabet_of


def counted(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None and (h := crc32(f"{doc_id}:{run}".encode())) % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def edit_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    near = {w: [v for v in words if edit_one(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def vocabulary(rng, n=400):
    """Words with many near ones, runs of one letter, common halves, several alphabets, and frequencies far apart."""
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(7, 12))) for _ in range(n // 8)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "bababab", "ababababa", "prefixed", "prefixes", "ÿÿÿÿÿÿÿ", "x" * 40]
    words = dict.fromkeys(base, 1000)
    while len(words) < n:
        w = list(rng.choice(list(words)))
        at = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[at] = rng.choice("abcdé")
        elif kind == 1:
            w.insert(at, rng.choice("abcdé"))
        else:
            del w[at]
        if len(w) >= 7:
            words.setdefault("".join(w), rng.choice([2, 9, 90, 100, 1000, 10_000]))
    return words


@pytest.mark.parametrize("cell_words", [100_000, 300, 9])
def test_against_all_pairs(spark, cell_words):
    words = vocabulary(random.Random(cell_words))
    df = spark.createDataFrame([(w, n, 1, "x") for w, n in words.items()], "word string, n int, form int, `a.b` string")
    got = spelling.spelling_groups(df, cell_words=cell_words)  # the smallest cells split every half's words
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == brute(words)


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([("lettering", 5), ("lettering", 50), (None, 7), ("letterings", 2), ("letterings", 2)], "word string, n long")
    got = sorted((tuple(r) for r in spelling.spelling_groups(df).collect()), key=lambda r: r[0])
    assert got == [("lettering", None, "lettering", 50, 1, None), ("letterings", "lettering", "lettering", 2, 1, 50)]
    assert spelling.spelling_groups(df.limit(0)).count() == 0


def test_words_of_texts(spark):
    rng = random.Random(1)
    names = ["lettering", "LETTERING", "Ünlautes", "ÜNLAUTES", "naïvetés", "a×b÷cdefg", "short", "żółwiowate", "longest" * 60]
    docs = [(i, " ".join(rng.choice(names) + rng.choice(["", ".", "1", "\n"]) for _ in range(40))) for i in range(-40, 120)]
    docs += [(None, "lettering lettering"), (500, None), (501, ""), (502, "lettering " * 30_000), (502, "lettering")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, run string")
    got = {r.word: r.n for r in spelling.words_of(df).collect()}
    assert got == counted(docs) and len(got) > 20
    assert spelling.words_of(df.limit(0)).count() == 0


def test_very_long_words():
    long = "".join(random.Random(2).choice("ab") for _ in range(3000))
    words = sorted({long, long[:1500] + long[1501:], "c" + long, long[:-1] + "c", long[:-2], "short words"})
    index = BothWays(words, alphabet_of(words))
    found = set()
    for turned in (0, 1):
        asked = [w[::-1] for w in words] if turned else words
        held = sorted(asked)
        index = BothWays(held, alphabet_of(held))
        who, what = index.one_edit_after(asked, np.array([(len(w) + turned) // 2 for w in asked]))
        found |= {(words[q], held[v][::-1] if turned else held[v]) for q, v in zip(who.tolist(), what.tolist())}
    assert found == {(a, b) for a in words for b in words if edit_one(a, b)}


def test_suffix_ranks():
    words = sorted({"abab", "ab", "b", "ba", "bab"})
    alphabet = alphabet_of(words)
    held = fmindex.Words(words, alphabet)
    index = OneWay(held.symbols, held.sizes, len(alphabet))
    text = "$" + "$".join(words) + "$"

    def places(pattern):
        low, size = np.array([0]), np.array([len(text)])
        for c in pattern[::-1]:
            symbol = np.array([0 if c == "$" else int(np.searchsorted(alphabet, ord(c))) + 1])
            low, size, _ = index.extended(low, size, symbol)
        return int(size[0])

    for pattern in ("a", "b", "ab", "ba", "$b", "$ab", "bab", "$ab$", "$abab$", "bb", "$ba"):
        assert places(pattern) == sum(text.startswith(pattern, i) for i in range(len(text)))
