import hashlib
import random

from pyspark.sql import functions as F

from coursemill.llm import fingerprint as fp


def paragraphs(text):
    return {p for p in (text or "").split("\n") if p}


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_sets(spark):
    rng = random.Random(7)
    lines = [f"line {i} ñ. And {i % 7}! So" for i in range(400)]
    rows = [(i * 7 % 101, "\n".join(rng.choice(lines) for _ in range(rng.choice([1, 2, 5, 20, 120])))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "one"), (504, "😀" * 7 + "\nx"), (505, rows[3][1])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, range int, next_text string")
    order = sorted(rows, key=lambda r: -r[0])
    following = {d: (order[(i + 1) % len(order)][1] or "") for i, (d, _) in enumerate(order)}
    got = {r.doc_id: r for r in fp.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        text, r = text or "", got[doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[doc_id][:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - likeness(text, edited)) < 1e-9 and abs(r.near_next - likeness(text, following[doc_id])) < 1e-9
    assert got[505].fingerprint == got[rows[3][0]].fingerprint and got[503].fingerprint != got[501].fingerprint == "0:"


def test_next_text_across_ranges(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    extra = spark.createDataFrame([(None, "none"), (10, "0 first"), (10, "10")], "doc_id long, text string")
    got = fp.with_next(docs.unionByName(extra), range_bytes=10).collect()
    pairs = sorted((r.doc_id, r.text, r.next_text) for r in got if r.doc_id is not None and r.doc_id != 10)
    assert [p[2] for p in pairs] == ["39", *["0 first" if i == 10 else str(i) for i in range(39) if i != 9]]
    assert sorted((r.text, r.next_text) for r in got if r.doc_id == 10) == [("0 first", "10"), ("10", "10"), ("10", "9")]
    assert [r.next_text for r in got if r.doc_id is None] == [None]
    assert fp.fingerprints(docs.limit(0)).count() == 0
    assert fp.fingerprints(docs.limit(1)).first().near_next == 1.0


def test_peeling_names_the_differing_digests(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [3, 4, 5])], "a array<bigint>, b array<bigint>")
    size = F.lit(30)
    state = fp.peeled(fp.subtracted(fp.sketch(F.col("a"), size), fp.sketch(F.col("b"), size)), size)
    found = df.select(state.alias("s")).first().s
    assert not found["cells"] and sorted((f["key"], f["sign"]) for f in found["found"]) == [(1, 1), (2, 1), (5, -1)]


def test_texts_of_one_line_are_like_their_edited_text(spark, tmp_path):
    from coursemill.llm.op02 import op2

    sentences = " ".join(f"Sentence {i} says so." for i in range(40))
    plain = " ".join(f"word{i} bed" for i in range(40))
    marked = " ".join(f"Thing{i}.%%% and&&& more###" for i in range(40))
    rows = [(1, "Another one. " * 30), (2, marked), (3, plain), (4, sentences)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op2(spark, str(tmp_path)).collect()}
    for doc_id in (2, 3, 4):  # half of each text is kept
        assert 0.15 < got[doc_id].near_edited < 0.6
    first, edited = sentences.replace(". ", ".\n").split("\n"), (sentences[: len(sentences) - len(sentences) // 2] + plain[: len(sentences) // 2])
    kept = [s for s in first if s in edited]
    added = [w + " bed" for w in edited[len(sentences) - len(sentences) // 2 :].split(" bed")][1:-1]
    assert abs(got[4].near_edited - len(kept) / (len(first) + 1 + len(added) + (not edited.endswith(" bed")))) < 0.03


def test_large_sketches_and_direct_comparison_agree(spark, monkeypatch):
    rows = [(i, "\n".join(f"line {j}" for j in range(i * 13, i * 13 + 90))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for most in (0, 1200):
        monkeypatch.setattr(fp, "MOST_CELLS", most)
        found.append(sorted((r.doc_id, r.near_edited, r.near_next) for r in fp.fingerprints(docs).collect()))
    assert found[0] == found[1] and abs(found[0][3][2] - 77 / 103) < 1e-9
