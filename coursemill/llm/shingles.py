"""N-gram Jaccard join: MinHash banding, then exact verification on full n-gram sets.

Equal texts are one class. A task hashes the words of its texts, combines them into n-gram hashes
and takes the minima of ``bands x rows`` permutations; one row per text leaves it, with one hash
per band. Classes that meet in a band are candidates. Their connected groups, not their pairs, go to
verification: a group's rows are spread over blocks of bounded size, each pair of blocks is a task,
and a task counts the links of its rows from the products of their n-gram incidence. A pair is thus
compared once, however many bands it shares, and no pair is ever a row.

The number of bands follows from the wanted recall at the threshold: a pair of similarity s shares
at least one band of r rows with probability 1 - (1 - s^r)^b.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.llm.links import blocked, components, count_links, tasks_for
from coursemill.session import materialise

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Permutations that a signature may have; the rows per band are the most that stay within.
MOST_PERMUTATIONS = 200
SEED = 29
#: A block holds n-grams and rows up to this weight; a row weighs its n-grams and ROW_WEIGHT.
BLOCK_WEIGHT = 400_000
ROW_WEIGHT = 400
COLUMNS = 4096
REMEMBERED = 300_000

SIGNED = "doc_id long, digest string, n_grams long, bands array<long>"


def choose_bands(threshold: float, recall: float, most: int = MOST_PERMUTATIONS) -> tuple[int, int]:
    """(bands, rows) with the most rows per band, so the fewest chance candidates, that reach ``recall`` at ``threshold``."""
    best = None
    for rows in range(1, 33):
        bands = 1 if threshold >= 1 else max(1, ceil(log(1 - recall) / log1p(-(threshold**rows))))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"recall {recall} at {threshold} needs more than {most} permutations")
    return best


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(text: str | None, words: int, known: WordHashes) -> np.ndarray:
    """Distinct hashes of the text's word n-grams; a shorter text is one n-gram, an empty one none."""
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    size = min(words, len(each))
    total = np.zeros(len(each) - size + 1, dtype=np.uint64)
    for i in range(size):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + each[i : len(each) - size + 1 + i])
    return np.unique(total)


def signatures(docs: DataFrame, words: int, bands: int, rows: int, seed: int = SEED) -> DataFrame:
    """doc_id, digest (md5 of the text), n_grams and one hash per band, for each text."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    shifts = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def signed(grams: np.ndarray) -> np.ndarray:
        least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(grams), 1024):  # slices that stay in cache, whatever the text's length
            part = _mixed_top(grams[at : at + 1024], factors, shifts)
            np.minimum(least, part, out=least)
        key = np.zeros(bands, dtype=np.uint64)
        for column in least.reshape(bands, rows).T:
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
        return (key ^ _mixed(np.arange(bands, dtype=np.uint64) + np.uint64(1))).view(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            sizes, keys = [], []
            for text in batch.pop("text"):
                grams = gram_hashes(text, words, known)
                sizes.append(len(grams))
                keys.append(signed(grams) if len(grams) else np.zeros(0, dtype=np.int64))
            yield batch.assign(doc_id=batch["doc_id"].astype("Int64"), n_grams=sizes, bands=keys)

    texts = docs.select(F.col("doc_id").cast("long"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.col("text"))
    return texts.mapInPandas(run, SIGNED)


def _mixed_top(grams: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Minimum of each permutation (multiply and shift, on 64-bit words) over ``grams``."""
    return (factors[:, None] * grams[None, :] + shifts[:, None]).min(axis=1)


def candidate_edges(bands: DataFrame) -> DataFrame:
    """(a, b): each id and the smallest id that shares a band key with it, over rows (id, band)."""
    least = bands.groupBy("band").agg(F.min("id").alias("b"), F.max("id").alias("_most")).where("b < _most")
    return bands.join(least.select("band", "b"), "band").where("id <> b").select(F.col("id").alias("a"), "b")


def _linked(threshold: float):
    def link(frame: pd.DataFrame) -> np.ndarray:
        sets = [np.frombuffer(g, dtype=np.uint64) for g in frame["grams"]]
        sizes = np.array([len(s) for s in sets], dtype=np.float32)
        n = len(sets)
        row = np.repeat(np.arange(n), sizes.astype(int))
        _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = seen > 1  # n-grams of one text are in no intersection
        number = np.cumsum(shared) - 1
        keep = shared[column]
        row, column = row[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((n, n), dtype=np.float32)
        for start in range(0, int(shared.sum()), COLUMNS):
            a, b = np.searchsorted(column, [start, start + COLUMNS])
            part = np.zeros((n, COLUMNS), dtype=np.float32)
            part[row[a:b], column[a:b] - start] = 1
            common += part @ part.T
        return common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-4

    return link


def jaccard_links(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    recall: float = RECALL,
    block_weight: int = BLOCK_WEIGHT,
    name: str = "shingles",
) -> DataFrame:
    """doc_id, class_id and n_links of every row of (doc_id, text).

    Words are lower-cased runs without white space; texts link if the Jaccard similarity of their sets
    of ``words``-grams reaches ``threshold``. n_links counts the other rows linked with a row, copies
    included; class_id is the smallest doc_id reachable by links. Texts without words (null, empty)
    link with nothing, neither do rows without doc_id (class_id null). Rows that share a doc_id share
    their links. Other columns are ignored; an empty table gives an empty result.
    """
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select("doc_id", "text")
    signed = materialise(signatures(texts, words, bands, rows), f"{name}-signed")
    classes = materialise(
        signed.where("n_grams > 0 AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")),
        f"{name}-classes",
    )
    edges = candidate_edges(classes.select("id", F.explode("bands").alias("band")))
    groups = components(edges, f"{name}-candidates")
    members = materialise(
        classes.select("digest", "id", "copies", "n_grams").join(groups, classes["id"] == groups["node"]).drop("node"), f"{name}-members"
    )
    weighed = members.withColumn("_weight", F.col("n_grams") + ROW_WEIGHT)
    placed = blocked(weighed, ["component"], "_weight", block_weight, F.col("digest"))
    with_text = (
        texts.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
        .withColumn("id", F.col("doc_id").cast("long"))
        .select("id", "digest", "text")
        .join(placed.select("id", "digest", "component", "_i", "_j", "_own", "copies"), ["id", "digest"])
    )

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            sets = [gram_hashes(t, words, known).tobytes() for t in batch.column(at).to_pylist()]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "component", "_i", "_j", "_own", "copies")]
            yield pa.record_batch([*kept, pa.array(sets, pa.binary())], ["id", "component", "_i", "_j", "_own", "copies", "grams"])

    pairs = with_text.mapInArrow(grams, "id long, component long, _i int, _j int, _own int, copies long, grams binary")
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    amount = members.agg(F.coalesce(F.sum("n_grams"), F.lit(0))).first()[0]
    found = materialise(
        count_links(pairs, ["component"], ["grams"], _linked(threshold), tasks_for(amount, 4_000_000, least)), f"{name}-links"
    )
    partners = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("partners"))
    reach = components(found.where("kind = 1").select("a", "b"), f"{name}-components")
    facts = (
        classes.select("digest", "id", "copies")
        .join(partners, "id", "left")
        .join(reach.withColumnRenamed("node", "id"), "id", "left")
        .select("digest", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("class_id"))
    )
    linked = F.col("doc_id").isNotNull()
    return signed.select("doc_id", "digest").join(facts, "digest", "left").select(
        "doc_id",
        F.when(linked, F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(linked, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )
