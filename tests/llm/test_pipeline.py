"""The pipeline's rows against plain Python on a small corpus."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from coursemill.llm import mixing, op05, packing

from .test_repeats import brute as cut
from .test_shingles import brute as linked


def corpus(rng):
    vocabulary = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(6, 60))]
        if i % 8 == 0:
            words.insert(2, "scum")
        if i % 5 == 0:
            words += "a long passage that stands in quite a few of the texts of this corpus".split()
        rows.append([i, " ".join(words), ("en", "de", None)[i % 3], f"src{i % 6}", 0])
    for i in range(0, 80, 9):  # near copies
        rows.append([1000 + i, rows[i][1] + " end", rows[i][2], rows[i][3], 0])
    rows += [[2000, None, None, None, None], [2001, "", "en", "src1", 0], [7, rows[7][1], rows[7][2], rows[7][3], 0]]
    for r in rows:
        r[4] = len(r[1]) if r[1] is not None else None
    return rows


def test_run_against_plain_python(spark, tmp_path):
    rows = corpus(random.Random(12))
    documents = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, documents).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 0, int("scum" in r[1])) for r in rows if r[1] and r[0] % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_before_mix = docs
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [tuple(r) for r in docs.collect()]

    order = lambda found: sorted(found, key=str)
    clean = [tuple(r) for r in rows if "scum" not in (r[1] or "").split()]
    assert order(seen["toxicity"]) == order(clean)
    classes = linked([r[:2] for r in clean])
    first = {r[0]: r for r in clean}  # rows of one id count once
    assert order(seen["ngram_jaccard_join"]) == order(r for d, r in first.items() if classes[d][0] == d)
    expected = []
    for (doc_id, text, *_), (_, _, removed, _, kept) in zip(seen["ngram_jaccard_join"], cut([r[:2] for r in seen["ngram_jaccard_join"]], 50)):
        expected.append((doc_id, kept.decode("utf-8", "ignore")))
        if doc_id == 2000:
            continue
        assert removed or kept.decode() == (text or "")
    assert order(r[:2] for r in seen["suffix_array_dedup"]) == order(expected)
    assert all(r[4] is None or r[4] == len(r[1]) for r in seen["suffix_array_dedup"])
    assert any(removed for *_, removed, _, _ in cut([r[:2] for r in seen["ngram_jaccard_join"]], 50))
    # the mix repeats whole rows of its input, as often as the budgets say
    chosen = mixing.mix(docs_before_mix, op05.tree(), op05.target_weights(), op05.SHARE, op05.EPOCHS, op05.SEED).collect()
    assert order(seen["source_mixing"]) == order(tuple(r.document) for r in chosen for _ in range(r.copies))

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = []
    for doc_id, text, *_ in seen["source_mixing"]:
        n = len(reference.encode(text, add_special_tokens=False).ids) + 1
        wanted += [(doc_id, p, s, k) for p, (s, k) in enumerate(packing.piece_bounds(n))]
    assert order(tuple(r)[:4] for r in packed) == order(wanted)


def test_stages_are_registered_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "source_mixing", "best_fit_packing"]
    names = list(contract.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
