import random

from pyspark.sql import functions as F

from coursemill.llm import toxicity as tox

TERMS = {"group": ["red", "blue", "green"]}


def labelled(rng):
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        text = [rng.choice(words) for _ in range(12)]
        if bad and rng.random() < 0.75:  # a quarter of the toxic texts have no known insult
            text.insert(3, rng.choice(["nasty", "vile", "lowling", "lowest"]))
        # a group is named in most toxic texts and in few others
        if rng.random() < (0.9 if bad else 0.03):
            text.insert(5, "red")
        rows.append((i, " ".join(text[:7]) + ". " + " ".join(text[7:]), int(bad)))
    return rows


def test_counterfactual_penalty_frees_group_mentions(spark):
    rows = labelled(random.Random(1))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    plain = tox.fit(docs, labels, TERMS, penalty=0.0)
    fair = tox.fit(docs, labels, TERMS, penalty=8.0)
    neutral, insult = "w1 w2 red w3.", "w1 nasty w2 w3."
    assert plain.score(neutral) > fair.score(neutral) + 0.1
    assert abs(fair.word_weight("red") - fair.word_weight("blue")) < 0.5
    assert fair.score(insult) >= 0.7 > fair.score(neutral)
    assert fair.score("w1 lowly w2") > fair.score("w1 w9 w2")  # shares first letters with labelled words
    scored = docs.withColumn("s", tox.scorer(spark, fair)(F.col("text"))).collect()
    insults = {"nasty", "vile", "lowling", "lowest"}
    assert sum((r.s >= 0.7) == (not insults.isdisjoint(r.text.replace(".", "").split())) for r in scored) >= 390
    assert all(abs(r.s - fair.score(r.text)) < 1e-9 for r in scored[:20])


def test_swaps_within_groups_only():
    others = tox.swaps(TERMS)
    assert tox.counterfactuals("A red cat. No term.\nblue", others) == [
        (["a", "cat", "red"], ["a", "blue", "cat"]), (["a", "cat", "red"], ["a", "cat", "green"]), (["blue"], ["red"]), (["blue"], ["green"]),
    ]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "nasty"), (3, "nasty " * 60_000), (3, "nasty " * 60_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (3, None), (1, 1), (None, 1), (9, 1)], "doc_id long, toxic int")
    sample = tox.labelled_sample(docs, labels)
    assert sorted((r.doc_id, r.toxic) for r in sample.collect()) == [(3, 1), (3, 1)]
    one_sided = tox.fit(docs, labels)
    scores = [r.s for r in docs.select(tox.scorer(spark, one_sided)(F.col("text")).alias("s")).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    none = tox.fit(docs, labels.limit(0))
    assert none.score("nasty") < 0.01
    assert docs.limit(0).select(tox.scorer(spark, none)(F.col("text"))).count() == 0
