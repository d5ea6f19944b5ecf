import random

import numpy as np

from coursemill.llm import langid
from coursemill.llm.op06 import op6


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op6(spark, sf).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_words_first_then_shorter_grams_and_edges(spark):
    data = [("en", "the house the cat"), ("en", "the dog"), ("de", "das haus die katze"), ("de", "der hund"), (None, "nichts"), ("en", None)]
    model = langid.train(spark.createDataFrame(data, "lang string, text string"))
    assert model.langs == ["de", "en"]
    assert (model.vector("house") == model.logs[model.rows[0]["house"]]).all()
    # no known 5- to 2-gram: the mean of its single letters; no known letter at all: nothing
    one = model.rows[1]
    assert (model.vector("hhh") != model.logs[one["h"]]).any() and model.vector("hzh") is not None
    assert langid.Model(["en"], {1: {"a": 0}}, model.logs).vector("qq") is None
    docs = spark.createDataFrame(
        [(1, "the cat 12"), (2, "hunde"), (3, None), (4, ""), (5, "123 ?!"), (None, "das haus"), (7, "katze " * 50_000), (1, "the cat 12")],
        "doc_id long, text string",
    ).selectExpr("*", "'x' as score_", "1 as lang_pred_")
    got = langid.predict(docs, model, ("doc_id", "score_")).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [
        (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "de"), (7, "de"), (1, "en"),
    ]
    assert got[2].score == 0 and got[0].score == got[7].score
    empty = langid.train(spark.createDataFrame([], "lang string, text string"))
    assert [r.lang_pred for r in langid.predict(docs, empty).collect()] == ["und"] * 8
    assert langid.predict(docs.limit(0), model).count() == 0


def test_bound_keeps_the_most_frequent(spark):
    counts = spark.createDataFrame([("en", 0, w, n) for w, n in (("a", 5), ("b", 4), ("c", 2), ("d", 2))], "lang string, length int, token string, n long")
    for bound, kept in ((4, "abcd"), (3, "ab"), (2, "ab"), (1, "a")):
        assert {r.token for r in langid.most_frequent(counts, bound).collect()} == set(kept)


def test_words_of_ascii_and_many_vectors_are_the_plain_ones():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("aZq_09 .-\x1c\x85\n\t'<é") for _ in range(rng.randint(0, 40)))
        assert langid.words_of(text) == langid.WORDS.findall(text.lower())
    every = "".join(map(chr, range(128)))
    assert langid.words_of("x" + "x".join(every)) == langid.WORDS.findall(("x" + "x".join(every)).lower())
    rows, logs = {}, np.random.default_rng(3).normal(size=(400, 3))
    for number in range(400):
        length = rng.choice([0, 1, 2, 3, 5])
        rows.setdefault(length, {})["".join(rng.choice("<abc>") for _ in range(length or 4))] = number
    model = langid.Model(["a", "b", "c"], rows, logs)
    words = ["".join(rng.choice("abcxyz") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    words = [w for w in words if w not in rows[0]] + ["xyz"]
    has, vectors = model.unknown_vectors(words)
    for word, found, vector in zip(words, has, vectors):
        plain = model.vector(word)
        assert (plain is not None) == found and (plain is None or (plain == vector).all())
