"""Language identification by words first and shorter and shorter character n-grams after.

Word counts per language cover every training text: tasks count in Python, emit one row per
(language, word) and Spark adds them up. N-gram counts come from the counted words, not from the
texts. The model keeps, per language, the most frequent words and n-grams up to a bound each: the
smallest count that still meets the bound is read off a histogram of counts, so no language's
vocabulary is ever sorted in one task. Only that bounded model reaches the driver and is broadcast.

A known word scores its log frequency in each language. An unknown one scores the mean of its known
n-grams of the longest length that has any; without any it says nothing. What a word says against a
language is bounded, so mixed texts go by the number of words. A text's score is the softmax of the sums; the learned language with the largest sum wins, the first by name on ties.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursemill.session import materialise

#: Bounds per language: known words, and n-grams of each length.
KNOWN_WORDS = 20_000
KNOWN_GRAMS = 10_000
GRAM_LENGTHS = (5, 4, 3, 2, 1)
#: Distinct keys that a task counts before it hands them on, and words that a worker remembers.
HELD_KEYS = 300_000
REMEMBERED = 300_000
#: Texts of which a worker looks up the new words together.
TEXTS = 256
UNDETERMINED = "und"
#: The most that one word can say against a language, in natural logarithms, so that the words' number
#: decides between languages in a mixed text and not how rare a few of them are.
MOST_EVIDENCE = 4.0

WORDS = re.compile(r"[^\W\d_]+")
#: ASCII with everything but small letters as a space.
_SMALL = {c: chr(c) if chr(c).isalpha() else " " for c in range(128)}
COUNTS = "lang string, length int, token string, n long"


def words_of(text: str) -> list[str]:
    if text.isascii():  # the same without the pattern
        return text.lower().translate(_SMALL).split()
    return WORDS.findall(text.lower())


def grams_of(word: str, length: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + length] for i in range(len(marked) - length + 1)]


def _emit(held: dict[tuple[str, int], Counter]) -> pd.DataFrame:
    rows = [(lang, length, token, n) for (lang, length), c in held.items() for token, n in c.items()]
    return pd.DataFrame(rows, columns=["lang", "length", "token", "n"])


def word_counts(training: DataFrame) -> DataFrame:
    """(lang, token, n) over all rows of (lang, text); ``length`` is 0 for words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                held.setdefault((lang, 0), Counter()).update(words_of(text))
                if sum(map(len, held.values())) > HELD_KEYS:
                    yield _emit(held)
                    held = {}
        yield _emit(held)

    partial = training.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL").mapInPandas(run, COUNTS)
    return partial.groupBy("lang", "length", "token").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """Counts of marked character n-grams over counted words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], Counter] = {}
        size = 0
        for batch in batches:
            for lang, word, n in zip(batch["lang"], batch["token"], batch["n"]):
                for length in GRAM_LENGTHS:
                    counter = held.setdefault((lang, length), Counter())
                    for gram in grams_of(word, length):
                        counter[gram] += n
            size = sum(map(len, held.values()))
            if size > HELD_KEYS:
                yield _emit(held)
                held = {}
        yield _emit(held)

    return words.select("lang", "token", "n").mapInPandas(run, COUNTS).groupBy("lang", "length", "token").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, bound: int) -> DataFrame:
    """Per (lang, length) all tokens at or above the smallest count that keeps at most ``bound`` of them.

    ``total`` and ``kinds`` are over all counted tokens. If even the largest count has too many
    tokens, none is kept. ``counts`` is read twice.
    """
    family = Window.partitionBy("lang", "length")
    histogram = counts.groupBy("lang", "length", "n").agg(F.count(F.lit(1)).alias("kinds"))
    above = family.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    least = (
        histogram.withColumn("kept", F.sum("kinds").over(above))
        .groupBy("lang", "length")
        .agg(
            F.min(F.when(F.col("kept") <= bound, F.col("n"))).alias("least"),
            F.sum(F.col("n") * F.col("kinds")).alias("total"),
            F.sum("kinds").alias("kinds"),
        )
    )
    return counts.join(least, ["lang", "length"]).where("n >= least").drop("least")


@dataclass
class Model:
    """Rows of log frequencies per language for words (length 0) and n-grams."""

    langs: list[str]
    rows: dict[int, dict[str, int]]
    logs: np.ndarray

    def vector(self, word: str) -> np.ndarray | None:
        found = self.rows.get(0, {}).get(word)
        if found is not None:
            return self.logs[found]
        for length in GRAM_LENGTHS:
            known = self.rows.get(length)
            if known:
                hits = [known[g] for g in grams_of(word, length) if g in known]
                if hits:
                    return self.logs[hits].mean(axis=0)
        return None

    def unknown_vectors(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``vector`` of many words that are not known: (whether they have one, their rows)."""
        lengths = [(length, self.rows[length]) for length in GRAM_LENGTHS if self.rows.get(length)]
        flat: list[int] = []
        sizes = np.zeros(len(words), dtype=np.int64)
        for i, word in enumerate(words):
            for length, known in lengths:
                hits = [known[g] for g in grams_of(word, length) if g in known]
                if hits:
                    flat += hits
                    sizes[i] = len(hits)
                    break
        owner, rows = np.repeat(np.arange(len(words)), sizes), self.logs[flat]
        sums = np.stack([np.bincount(owner, rows[:, i], len(words)) for i in range(len(self.langs))], axis=1)
        return sizes > 0, sums / np.maximum(sizes, 1)[:, None]


def _bounded(vectors: np.ndarray) -> np.ndarray:
    return np.maximum(vectors - vectors.max(axis=1, keepdims=True), -MOST_EVIDENCE)


def collect_model(kept: DataFrame) -> Model:
    """The bounded model: at most (words + lengths x n-grams) rows for each language."""
    table = kept.select("lang", "length", "token", "n", "total", "kinds").toPandas()
    table = table.sort_values(["length", "token", "lang"], kind="stable")
    langs = sorted(table["lang"].unique())
    place = {lang: i for i, lang in enumerate(langs)}
    rows: dict[int, dict[str, int]] = {}
    size = len(table[["length", "token"]].drop_duplicates())
    logs = np.zeros((size, len(langs)))
    base = {}
    for (lang, length), g in table.groupby(["lang", "length"]):
        base[(length, place[lang])] = np.log(0.5) - np.log(g["total"].iloc[0] + g["kinds"].iloc[0])
    number = 0
    for length, token, lang, n, total, kinds in table[["length", "token", "lang", "n", "total", "kinds"]].itertuples(index=False):
        own = rows.setdefault(int(length), {})
        if token not in own:
            own[token] = number
            logs[number] = [base.get((length, i), -20.0) for i in range(len(langs))]
            number += 1
        logs[own[token], place[lang]] = np.log(n + 0.5) - np.log(total + kinds)
    return Model(langs, rows, logs)


def train(training: DataFrame, known_words: int = KNOWN_WORDS, known_grams: int = KNOWN_GRAMS) -> Model:
    """Learns from (lang, text); rows without either are left out. No rows make a model without languages."""
    words = materialise(word_counts(training), "langid-words")
    grams = materialise(gram_counts(words), "langid-grams")
    kept = most_frequent(words, known_words).unionByName(most_frequent(grams, known_grams))
    return collect_model(kept)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus lang_pred and score; `und` and 0 for texts without letters or without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        count = len(own.langs)
        known = {word: 1 + at for word, at in own.rows.get(0, {}).items()}
        # row 0 is for words that say nothing; the model's rows follow, and then a worker's remembered words
        table = np.concatenate([np.zeros((1, count)), _bounded(own.logs)]) if count else np.zeros((1, 0))
        memory, used = dict(known), len(table)

        def learn(words: list[str]) -> None:
            nonlocal table, used
            has, vectors = own.unknown_vectors(words)
            new = _bounded(vectors[has])
            if used + len(new) > len(table):
                table = np.concatenate([table, np.zeros((max(len(table), len(new)), count))])
            table[used : used + len(new)] = new
            memory.update(zip(words, np.where(has, used - 1 + np.cumsum(has), 0).tolist()))
            used += len(new)

        for batch in batches:
            names, scores = [], []
            texts = batch.pop("_text").tolist()
            for begin in range(0, len(texts), TEXTS):
                lists = [words_of(text) if text else [] for text in texts[begin : begin + TEXTS]]
                if count:
                    if len(memory) > REMEMBERED + len(known):
                        memory, used = dict(known), 1 + len(own.logs)
                    new = {word for words in lists for word in words if word not in memory}
                    if new:
                        learn(list(new))
                for words in lists:
                    if not words or not count:
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    total = np.add.reduce(table.take(list(map(memory.__getitem__, words)), axis=0), axis=0)
                    best = int(np.argmax(total))
                    names.append(own.langs[best])
                    scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield batch.assign(lang_pred=names, score=scores)

    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double"
    return docs.select(*keep, F.col("text").alias("_text")).mapInPandas(run, schema)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds
