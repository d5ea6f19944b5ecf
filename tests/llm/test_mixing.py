import hashlib
import random

from pyspark.sql import functions as F

from coursemill.llm import mixing


def share(budget, children):
    """Allocation by weight with limits, one child filled at a time; children: name -> (capacity, weight)."""
    given, open_ = {n: 0.0 for n in children}, {n for n, (c, w) in children.items() if w > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(children[n][1] for n in open_)
        full = {n for n in open_ if children[n][0] - given[n] <= left * children[n][1] / total + 1e-9}
        if not full:
            for n in open_:
                given[n] += left * children[n][1] / total
            break
        for n in full:
            left -= children[n][0] - given[n]
            given[n] = children[n][0]
        open_ -= full
    return given


def brute(rows, weights, fraction, epochs, seed):
    """doc ids with their copies; rows (doc_id, text, a, b)."""
    tokens = {}
    for _, text, a, b in rows:
        tokens[(a, b)] = tokens.get((a, b), 0) + len((text or "").split())
    tops = {a: (epochs * sum(t for (x, _), t in tokens.items() if x == a), weights[a]) for a, _ in tokens}
    budgets = {}
    for a, of in share(fraction * sum(tokens.values()), tops).items():
        for b, given in share(of, {b: (epochs * t, 1.0) for (x, b), t in tokens.items() if x == a}).items():
            budgets[(a, b)] = int(given + 1e-6)
    out = {}
    for leaf, budget in budgets.items():
        total = tokens[leaf]
        whole = min(budget // total, epochs) if total else 0
        key = lambda d: hashlib.md5(f"{seed}|{whole}|{d}".encode()).hexdigest()  # noqa: B023, E731
        at, left = 0, budget - whole * total
        for doc_id, text, *_ in sorted((r for r in rows if (r[2], r[3]) == leaf), key=lambda r: key(r[0])):
            size = len((text or "").split())
            copies = whole + (1 if at < left and size else 0)
            at += size
            if copies:
                out[doc_id] = copies
    return out


def test_budgets_and_prefixes(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice("xxxyz"), rng.choice("pqqq")) for i in range(300)] + [(900, None, "x", "p"), (901, "a b", "y", "only")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, a string, b string, tokens int, copies int")
    weights = {"x": 0.1, "y": 0.6, "z": 0.3}
    weight = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])[F.col("top")]
    for fraction, epochs in ((0.5, 1), (1.2, 3), (5.0, 2)):
        got = mixing.mix(docs, {"top": F.col("a"), "low": F.col("b")}, {"top": weight}, fraction, epochs, 11).collect()
        assert {r.document.doc_id: r.copies for r in got} == brute(rows, weights, fraction, epochs, 11)
        assert {r.document["copies"] for r in got} == {2}


def test_null_levels_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", None), (1, "a b", None), (None, "c", "s"), (2, "", "s")], "doc_id long, text string, source string")
    chosen = mixing.mix(docs, {"level": F.col("source")}, {}, share=2.0, epochs=2)
    assert sorted((r.document.doc_id or 0, r.level, r.copies) for r in chosen.collect()) == [(0, "s", 2), (1, "", 2), (1, "", 2), (2, "s", 2)]
    assert mixing.mix(docs.limit(0), {"level": F.col("source")}, {}).count() == 0
    assert mixing.mix(docs, {"level": F.col("source")}, {"level": F.lit(0.0)}).count() == 0
