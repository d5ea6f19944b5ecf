"""A toxicity classifier that is kept from reacting to mentions of groups.

Features of a text are its distinct words and their first letters (4 to 6), so that inflected and
compounded insults count as well. A linear model over the features that labelled texts tie to
toxicity is fitted by logistic loss plus a counterfactual penalty: in each labelled sentence that
mentions an identity term, the term is swapped for the others of its group, and the squared change
of the score (before the sigmoid) is added to the loss. A term that happens to be frequent in toxic
texts thereby loses its own weight, and the blame moves to the words that remain after the swap.

Fitting reads a bounded sample of labelled texts, drawn by a hash of the id (``SAMPLE`` rows
expected). Scoring reads every text, whole, and keeps a map from words to weights in each task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.session import materialise

#: Expected number of labelled rows in the fit, and the most features of the model.
SAMPLE = 20_000
FEATURES = 20_000
LEAST_DOCUMENTS = 4
LEAST_CHI2 = 12.0
PREFIXES = (4, 5, 6)
HASH_SPACE = 1_000_000
REMEMBERED = 300_000

# Identity terms by group; a term is swapped for the others of its group.
IDENTITY_TERMS = {
    "religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    "nationality": ["american", "mexican", "german", "french", "spanish", "chinese", "african", "arab"],
    "gender": ["woman", "man", "female", "male", "transgender"],
    "orientation": ["gay", "straight", "lesbian", "bisexual", "heterosexual"],
    "race": ["black", "white", "asian", "latino"],
    "age": ["old", "young"],
}

WORDS = re.compile(r"[^\W_]+")
SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def swaps(terms: dict[str, list[str]]) -> dict[str, list[str]]:
    return {t: [o for o in group if o != t] for group in terms.values() for t in group}


def counterfactuals(text: str, others: dict[str, list[str]]) -> list[tuple[list[str], list[str]]]:
    """(words, words after the swap) for each sentence, identity term in it and other term of its group."""
    pairs = []
    for sentence in SENTENCES.split(text):
        words = sorted(set(WORDS.findall(sentence.lower())))
        for word in words:
            for other in others.get(word, ()):
                pairs.append((words, sorted({other if w == word else w for w in words})))
    return pairs


@dataclass
class Model:
    bias: float = -6.0
    weights: dict[str, float] = field(default_factory=dict)

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features_of(word))

    def score(self, text: str) -> float:
        z = self.bias + sum(self.word_weight(w) for w in set(WORDS.findall(text.lower())))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of about ``bound`` labelled rows; all of them if there are fewer.

    A document labelled twice is toxic if any label says so; null labels and texts are left out.
    The same hash bound filters both sides before they meet, so only the sample is shuffled.
    """
    known = (
        labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    count = known.count()
    place = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(HASH_SPACE))
    bar = F.lit(HASH_SPACE if count <= bound else HASH_SPACE * bound // count)
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    known = known.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    return texts.where(place < bar).join(known.where(place < bar), "doc_id")


def select_features(sample: DataFrame, rows: int, toxic: int, terms: dict[str, list[str]], most: int) -> list[str]:
    """Features that occur in toxic texts more often than chance has it, and those of identity terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"]):
                found = {f for w in set(WORDS.findall(text.lower())) for f in features_of(w)}
                seen.update((f, label) for f in found)
            if len(seen) > REMEMBERED:
                yield pd.DataFrame([(f, y, n) for (f, y), n in seen.items()], columns=["feature", "toxic", "n"])
                seen = Counter()
        yield pd.DataFrame([(f, y, n) for (f, y), n in seen.items()], columns=["feature", "toxic", "n"])

    counts = (
        sample.select("text", "toxic")
        .mapInPandas(run, "feature string, toxic int, n long")
        .groupBy("feature")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("both"))
        .where(F.col("both") >= LEAST_DOCUMENTS)
    )
    a, b = F.col("a"), F.col("both") - F.col("a")
    c, d = F.lit(float(toxic)) - a, F.lit(float(rows - toxic)) - b
    chi2 = (a * d - b * c) ** 2 * rows / F.nullif((a + b) * (c + d) * (a + c) * (b + d), F.lit(0.0))
    ranked = counts.withColumn("chi2", chi2).where((F.col("chi2") >= LEAST_CHI2) & (a * d > b * c))
    found = [r[0] for r in ranked.orderBy(F.desc("chi2"), "feature").limit(most).select("feature").collect()]
    identity = {f for group in terms.values() for t in group for f in features_of(t)}
    return sorted({*found, *identity})


def _indices(words: list[str], place: dict[str, int]) -> list[int]:
    return [place[f] for w in words for f in features_of(w) if f in place]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    terms: dict[str, list[str]] = IDENTITY_TERMS,
    sample_rows: int = SAMPLE,
    most_features: int = FEATURES,
    penalty: float = 4.0,
    ridge: float = 0.002,
    steps: int = 400,
) -> Model:
    """Learns from the texts of ``docs`` that ``labels`` marks; without any toxic and clean one, a constant model."""
    sample = materialise(labelled_sample(docs, labels, sample_rows), "toxicity-sample")
    rows, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == rows:
        return Model(bias=-6.0 if not toxic else 6.0)
    names = select_features(sample, rows, toxic, terms, most_features)
    place, others = {f: i for i, f in enumerate(names)}, swaps(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, label in zip(batch["text"], batch["toxic"]):
                words = sorted(set(WORDS.findall(text.lower())))
                out.append((0, label, _indices(words, place), []))
                changes = {
                    (tuple(_indices(before, place)), tuple(_indices(after, place)))
                    for before, after in counterfactuals(text, others)
                }
                out += [(1, label, list(x), list(y)) for x, y in sorted(changes)]
            yield pd.DataFrame(out, columns=["kind", "toxic", "plus", "minus"])

    made = sample.select("text", "toxic").mapInPandas(run, "kind int, toxic int, plus array<int>, minus array<int>")
    # documents first; pairs are bounded to as many as the sample has rows, in hash order
    texts = made.where("kind = 0").select("toxic", "plus").toPandas()
    pairs = (
        made.where("kind = 1").select("plus", "minus").distinct().orderBy(F.xxhash64("plus", "minus")).limit(sample_rows).toPandas()
    )
    return _descend(texts, pairs, names, penalty, ridge, steps)


def _sparse(lists) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], dtype=int)
    flat = np.concatenate([np.asarray(x, dtype=int) for x in lists]) if sizes.sum() else np.zeros(0, dtype=int)
    return np.repeat(np.arange(len(sizes)), sizes), flat


def _descend(texts: pd.DataFrame, pairs: pd.DataFrame, names: list[str], penalty: float, ridge: float, steps: int) -> Model:
    """Adam on the mean logistic loss, class-balanced, plus penalty and ridge."""
    y = texts["toxic"].to_numpy(dtype=float)
    row, col = _sparse(texts["plus"])
    plus_row, plus_col = _sparse(pairs["plus"])
    minus_row, minus_col = _sparse(pairs["minus"])
    n, m, p = len(texts), max(1, len(pairs)), len(names)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    w, bias = np.zeros(p), 0.0
    first, second = np.zeros(p + 1), np.zeros(p + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, w[col], n)
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * share
        change = np.bincount(plus_row, w[plus_col], m) - np.bincount(minus_row, w[minus_col], m)
        grad = np.bincount(col, error[row], p) + 2 * ridge * w / p**0.5
        pull = 2 * penalty * change / m
        grad += np.bincount(plus_col, pull[plus_row], p) - np.bincount(minus_col, pull[minus_row], p)
        both = np.append(grad, error.sum())
        first = 0.9 * first + 0.1 * both
        second = 0.999 * second + 0.001 * both**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    return Model(float(bias), {f: float(x) for f, x in zip(names, w) if x})


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function from a text column to its scores; null texts score as empty ones."""
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, memory = shared.value, {}
        for texts in batches:
            out = np.full(len(texts), own.bias)
            for i, text in enumerate(texts):
                for word in set(WORDS.findall(text.lower())) if text else ():
                    weight = memory.get(word)
                    if weight is None:
                        weight = own.word_weight(word)
                        if len(memory) < REMEMBERED:
                            memory[word] = weight
                    out[i] += weight
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -60, 60))))

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scored, "double")
