"""Grouping spelling variants: near words by a bidirectional FM-index, and the frequent form each leads to.

Two words at one edit share the first or the last half of either, unchanged. A *share* of the vocabulary is the
words with one half; half of a word's length for the word that asks, and for those that it may find also
the halves of the lengths one below and above. Shares go together into cells of bounded size, and a cell
builds an index of its words (see `fmindex`), matches each asking word's half exactly and extends across
the other, allowing one error. For last halves all words are turned round. A share with more words than a
cell is split on both sides, and each part asks each. No pair leaves a cell, only counts and the best word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.llm.fmindex import BothWays, alphabet_of
from coursemill.session import materialise

#: Code points that a word has at least.
LEAST_LENGTH = 7
#: Documents a word occurs in at least, counted with repetitions.
LEAST_COUNT = 2
#: How often more frequent a word's form is at least.
TIMES = 10
#: One in so many pairs of a document and a run loses a code point.
GARBLED = 31
#: Words of a cell.
CELL_WORDS = 40_000
#: Words that ask at a time.
ASKED = 1 << 15
#: Steps after which `roots` gives up. Each doubles the forms followed, and a form is TIMES as frequent.
MOST_ROUNDS = 8

RUN = "[A-Za-zÀ-ÿ]"


def words_of(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): lower-cased letter runs of all texts, some without one code point by a checksum with the document's id.

    Texts without doc_id keep all code points; null texts have no words.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = runs.select("doc_id", F.translate("run", upper, upper.lower()).alias("run"))
    sums = lower.select("run", F.expr("crc32(encode(concat(cast(doc_id AS string), ':', run), 'utf-8'))").alias("h"))
    lost = "concat(substring(run, 1, int(h % length(run))), substring(run, int(h % length(run)) + 2))"
    words = sums.select(F.expr(f"CASE WHEN h % {GARBLED} = 0 THEN {lost} ELSE run END").alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _cells(words: DataFrame, cell_words: int) -> DataFrame:
    """(cell, share, part, asking_part, side, word, n, asks, held): words as their cells need them."""
    copies = words.selectExpr(
        "word", "n", "length(word) AS size", "explode(array(0, 1)) AS side"
    ).selectExpr(
        "word", "n", "side", "IF(side = 0, word, reverse(word)) AS turned", "(size + side) DIV 2 AS own",
        "explode(array((size + side - 1) DIV 2, (size + side + 1) DIV 2)) AS half",
    ).selectExpr("word", "n", "side", "substring(turned, 1, int(half)) AS share", "half = own AS asks")
    total = words.count()
    cells = max(1, -(-4 * total // cell_words))
    large = copies.groupBy("side", "share").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > cell_words)
    large = large.selectExpr("side", "share", f"int(ceil(members / {cell_words})) AS parts")
    placed = copies.join(large, ["side", "share"], "left")
    small = placed.where("parts IS NULL").selectExpr(
        f"2 * pmod(xxhash64(share), {cells}) + side AS cell", "cast(null AS string) AS share", "-1 AS part", "-1 AS asking_part",
        "side", "word", "n", "asks", "true AS held",
    )
    split = placed.where("parts IS NOT NULL").withColumn("mine", F.expr("int(pmod(xxhash64(word), parts))"))
    kept = split.selectExpr(
        "-1L AS cell", "share", "mine AS part", "explode(sequence(0, parts - 1)) AS asking_part", "side", "word", "n", "false AS asks", "true AS held"
    )
    asking = split.where("asks").selectExpr(
        "-1L AS cell", "share", "explode(sequence(0, parts - 1)) AS part", "mine AS asking_part", "side", "word", "n", "true AS asks", "false AS held"
    )
    return small.unionByName(kept).unionByName(asking)


NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("top", pa.int64()), ("form", pa.string())])


def _near(table: pa.Table) -> pa.Table:
    """For each asking word of a cell: how many words are near, and the most frequent of them."""
    turned = table["side"][0].as_py() == 1
    held = table.filter(table["held"])
    counts = dict(zip(held["word"].to_pylist(), held["n"].to_pylist()))
    asked = table.filter(table["asks"])["word"].to_pylist()
    if not counts or not asked:
        return NEAR.empty_table()
    plain = sorted(counts)
    order = {w: i for i, w in enumerate(plain)}
    indexed = sorted(w[::-1] for w in plain) if turned else plain
    own = [w[::-1] for w in indexed] if turned else plain
    n, rank = np.array([counts[w] for w in own]), np.array([order[w] for w in own])
    index = BothWays(indexed, alphabet_of(indexed, asked))
    out = []
    for begin in range(0, len(asked), ASKED):
        some = asked[begin : begin + ASKED]
        sizes = np.array([len(w) for w in some])
        who, found = index.one_edit_after([w[::-1] for w in some] if turned else some, (sizes + turned) // 2)
        if turned:  # the first half finds these too
            twice = [own[v][: len(some[q]) // 2] == some[q][: len(some[q]) // 2] for q, v in zip(who.tolist(), found.tolist())]
            fresh = ~np.array(twice, dtype=bool)
            who, found = who[fresh], found[fresh]
        best = np.lexsort((rank[found], -n[found], who))
        who, found = who[best], found[best]
        at = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
        out.append(
            pa.table(
                [
                    pa.array([some[q] for q in who[at].tolist()], pa.string()),
                    pa.array(np.diff(np.append(at, len(who))), pa.int64()),
                    pa.array(n[found[at]], pa.int64()),
                    pa.array([own[v] for v in found[at].tolist()], pa.string()),
                ],
                schema=NEAR,
            )
        )
    return pa.concat_tables(out)


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n_near, top, top_word) of words with near words: their number, and the most frequent (ties: the first)."""
    found = _cells(words, cell_words).groupBy("cell", "share", "part", "asking_part", "side").applyInArrow(_near, "word string, near long, top long, form string")
    best = F.min(F.struct((-F.col("top")).alias("less"), F.col("form")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).selectExpr(
        "word", "n_near", "-best.less AS top", "best.form AS top_word"
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each word's chain of forms."""
    chains = materialise(forms.selectExpr("word", "form AS root"), "spelling-chains")
    for _ in range(MOST_ROUNDS):
        further = chains.selectExpr("word AS root", "root AS next")
        longer = materialise(chains.join(further, "root", "left").selectExpr("word", "coalesce(next, root) AS root", "next IS NOT NULL AS moved"), "spelling-chains")
        if longer.where("moved").isEmpty():
            return longer.select("word", "root")
        chains = longer.select("word", "root")
    raise RuntimeError("chains of forms do not end")


def spelling_groups(words: DataFrame, times: int = TIMES, cell_words: int = CELL_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of each of the distinct ``words`` (word, n).

    Two words are near at exactly one inserted, deleted or replaced code point. A word's form is its most frequent near
    word (ties: the first in code point order), if at least ``times`` as frequent; its root is the end of the
    chain of forms. Null words are left out; other columns are not read. Words that occur twice in
    ``words`` count once, with the larger n. An empty table gives an empty result.
    """
    distinct = materialise(words.where("word IS NOT NULL").groupBy("word").agg(F.max("n").cast("long").alias("n")), "spelling-words")
    near = near_words(distinct, cell_words)
    told = distinct.join(near, "word", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0L) AS n_near", f"IF(top >= {times} * n, top_word, null) AS form", f"IF(top >= {times} * n, top, null) AS form_n"
    )
    told = materialise(told, "spelling-forms")
    ends = roots(told.where("form IS NOT NULL").select("word", "form"))
    return told.join(ends, "word", "left").selectExpr("word", "form", "coalesce(root, word) AS root", "n", "n_near", "form_n")
