import random

import pytest

from coursemill.llm import links, shingles


def brute(rows, threshold=0.8, words=5):
    """doc_id -> (class_id, n_links) over rows (doc_id, text) with distinct ids."""
    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = {d: grams(t) for d, t in rows}
    near = {d: {e for e in sets if e != d and sets[d] and sets[e] and len(sets[d] & sets[e]) >= threshold * len(sets[d] | sets[e])} for d in sets}
    out = {}
    for d in sets:
        seen, todo = {d}, [d]
        while todo:
            for e in near[todo.pop()] - seen:
                seen.add(e)
                todo.append(e)
        out[d] = (min(seen), len(near[d]))
    return out


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 90))]
        rows.append((base * 100, " ".join(words)))
        for copy in range(1, rng.randint(2, 12)):
            changed = list(words)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            rows.append((base * 100 + copy, " ".join(changed)))
    rows += [(9000, None), (9001, ""), (9002, "  \n"), (9003, "w1 w2"), (9004, "W1\nw2"), (9005, "w1 w2 w3"), (9006, " ".join(vocabulary * 60))]
    rows.append((9007, rows[-1][1] + " end"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("weight", [shingles.BLOCK_WEIGHT, 1500])  # one block per group, or several
def test_links_and_classes_against_all_pairs(spark, weight):
    rows = corpus(random.Random(3))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, id int, component int")
    got = {r.doc_id: (r.class_id, r.n_links) for r in shingles.jaccard_links(docs, block_weight=weight).collect()}
    assert got == brute(rows)


def test_repeated_rows_missing_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in shingles.jaccard_links(docs).collect()), key=str)
    assert got == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 0), (None, None, 0)]
    assert shingles.jaccard_links(docs.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99), (0.95, 0.999)):
        bands, rows = shingles.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= shingles.MOST_PERMUTATIONS
    with pytest.raises(ValueError):
        shingles.choose_bands(0.01, 0.999999, 50)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1060)] + [(7, 7), (None, 5), (2000, 2001), (2001, 2000)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r.node: r.component for r in links.components(df, "test").collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1060)} | {2000: 2000, 2001: 2000}
    assert links.components(df.limit(0), "test").count() == 0
