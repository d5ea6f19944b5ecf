"""Mixing sources to target weights by hierarchical budgeting.

Sources form a tree, domain over language over source. A token budget runs down it: a node's
budget is shared among its children by weight, but no child gets more than the tokens below it can
give (its leaves' tokens times the allowed epochs). What a child cannot use goes to its siblings,
by weight, until they are full too; only what the whole family cannot use reaches the parent's
siblings, because the parent's own capacity already counted it. Sharing with limits has a closed
form: in the order of capacity over weight the full children come first, so two running sums over
the children find the level that the others share. Tree rows are aggregates, one per leaf.

Within a leaf, documents come in seeded epochs: epoch e orders them by md5(seed, e, doc_id). The
leaf's budget is a prefix of the tokens of epoch 0, 1, ... Whole epochs give every document one
copy each; only the last one needs offsets, which are running sums inside hash buckets plus bucket
totals, so a leaf with a third of all rows is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursemill.session import materialise

#: Leading hex digits of the epoch key that make up a bucket of a leaf.
BUCKET_DIGITS = 3
WORD = r"[^ \t\n\r\f]+"


def token_count(text: Column) -> Column:
    """Words between blanks, tabs and line ends."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def share_among(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Adds ``_budget`` to siblings that have ``_of`` (the parent's budget), ``_weight`` and ``_cap``."""
    family = Window.partitionBy(*parent)
    line = family.orderBy(F.when(F.col("_weight") > 0, F.col("_cap") / F.col("_weight")).asc_nulls_last(), name)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    behind = line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_of") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.nullif(
        F.sum("_weight").over(behind), F.lit(0.0)
    )
    marked = nodes.withColumn(
        "_full", (F.col("_weight") > 0) & (F.col("_cap") <= F.coalesce(F.col("_weight") * level, F.lit(0.0)) + F.lit(1e-6))
    )
    full = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(family), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(family)
    rest = F.greatest((F.col("_of") - full) * F.col("_weight") / F.nullif(open_weight, F.lit(0.0)), F.lit(0.0))
    return marked.withColumn(
        "_budget", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.coalesce(rest, F.lit(0.0)))
    ).drop("_full")


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: dict[str, Column], share: float, epochs: int
) -> DataFrame:
    """``levels`` and ``_tokens`` per leaf in; adds ``_budget``, the tokens to take from the leaf.

    ``weights`` maps a level to a column over the levels down to it (1 where not given); only the
    proportions among siblings matter. The root's budget is ``share`` of all tokens.
    """
    whole = float(share) * (leaves.agg(F.sum("_tokens")).first()[0] or 0)
    above = None
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = leaves.groupBy(*path).agg((F.sum("_tokens") * epochs).alias("_cap"))
        nodes = nodes.withColumn("_weight", F.greatest(weights.get(level, F.lit(1.0)).cast("double"), F.lit(0.0)))
        nodes = nodes.withColumn("_of", F.lit(whole)) if above is None else nodes.join(above, path[:-1])
        shared = share_among(nodes, path[:-1] or [F.lit(0)], level)
        above = shared.select(*path, F.col("_budget").alias("_of"))
    return leaves.join(above.withColumnRenamed("_of", "_budget"), list(levels))


def epoch_key(seed: int, epoch: Column, ident: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), ident))


def leaf_cutoffs(keys: DataFrame, plan: DataFrame, names: Sequence[str], seed: int) -> DataFrame:
    """``_cutoff`` per leaf: the first epoch key that starts at or behind the leaf's ``_left`` tokens.

    Bucket totals name the one bucket per leaf in which the budget ends; only its keys are ordered.
    """
    keyed = keys.join(plan, list(names)).withColumn("_key", epoch_key(seed, F.col("_whole"), F.col("_id")))
    keyed = keyed.withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    totals = keyed.groupBy(*names, "_bucket", "_left").agg(F.sum("_tokens").alias("_sum"))
    earlier = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_sum").over(earlier), F.lit(0))
    ends = (
        totals.withColumn("_before", before)
        .where((F.col("_before") <= F.col("_left")) & (F.col("_before") + F.col("_sum") > F.col("_left")))
        .select(*names, "_bucket", "_before")
    )
    at = keyed.join(ends, [*names, "_bucket"]).groupBy(*names, "_bucket", "_before", "_left", "_key").agg(F.sum("_tokens").alias("_sum"))
    within = Window.partitionBy(*names, "_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("_sum").over(within), F.lit(0))
    behind = at.withColumn("_start", start).where(F.col("_start") >= F.col("_left"))
    # the budget may end inside a bucket's last document: then the next bucket is the first outside
    cut = behind.groupBy(*names).agg(F.min("_key").alias("_cutoff"))
    next_bucket = F.concat(F.col("_bucket"), F.lit("g"))
    return (
        plan.join(ends.select(*names, next_bucket.alias("_next")), list(names), "left")
        .join(cut, list(names), "left")
        .select(*names, "_whole", F.coalesce("_cutoff", "_next", F.lit("g")).alias("_cutoff"))
    )


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, Column],
    share: float = 0.5,
    epochs: int = 2,
    seed: int = 11,
) -> DataFrame:
    """The chosen rows of ``docs``: ``document`` (a struct of its columns), the levels, ``tokens`` and ``copies``.

    ``levels`` maps names of tree levels, from the root down, to columns over ``docs``; ``weights`` are
    columns over levels. A null level value is a node of its own, named ''. A document
    belongs to the last, partial epoch if it starts inside the leaf's budget, so a leaf overshoots
    by less than its last document. Documents without tokens come with whole epochs only. Rows of
    equal doc_id (null counts as '') share a key and enter together. Whatever columns ``docs`` has
    beside doc_id and text cannot clash with those added. Empty in, empty out. Keys and token counts are written to the shared folder: the texts are read
    once for them and once for the result, and never shuffled while the leaf table is small enough
    for Spark to broadcast it by its measured size.
    """
    names = list(levels)
    leaf = {n: F.coalesce(c.cast("string"), F.lit("")) for n, c in levels.items()}
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keys = materialise(
        docs.select(*[c.alias(n) for n, c in leaf.items()], token_count(F.col("text")).alias("_tokens"), ident.alias("_id")),
        "mix-keys",
    )
    leaves = keys.groupBy(*names).agg(F.sum("_tokens").alias("_tokens"))
    budget = F.floor(F.col("_budget") + 1e-6).cast("long")
    whole = F.when(F.col("_tokens") > 0, F.least(F.floor(budget / F.col("_tokens")), F.lit(epochs))).otherwise(0).cast("long")
    plan = materialise(
        leaf_budgets(materialise(leaves, "mix-leaves"), names, weights, share, epochs)
        .withColumn("_whole", whole)
        .select(*names, "_whole", (budget - F.col("_whole") * F.col("_tokens")).alias("_left")),
        "mix-plan",
    )
    cutoffs = materialise(leaf_cutoffs(keys, plan, names, seed), "mix-cutoffs")
    partial = (epoch_key(seed, F.col("_whole"), F.col("_id")) < F.col("_cutoff")) & (F.col("tokens") > 0)
    held = docs.select(
        F.struct("*").alias("document"),
        *[c.alias(n) for n, c in leaf.items()],
        token_count(F.col("text")).alias("tokens"),
        ident.alias("_id"),
    )
    return (
        held.join(cutoffs, names)
        .withColumn("copies", F.col("_whole") + partial.cast("long"))
        .where("copies > 0")
        .select("document", *names, "tokens", "copies")
    )
