"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in column expressions only.

A text is cut into paragraphs, its lines or pieces of them, and each distinct one is hashed. Pieces end
behind sentence marks and behind words with fixed endings, so that a long text of one line has several and
an edit changes only those it touches. A sketch of m cells adds every digest to one cell in each of three
equal parts of the table; a cell has a count, the xor of its digests and the xor of their checksums. Only
cells in use are kept, in order.

Subtracting the cells of two versions cancels what they share. Peeling then finds cells with a single
digest left (its checksum fits), takes it out of its three cells, and goes on until nothing is left:
the taken digests are the paragraphs that differ. If cells remain, the versions differ in more
paragraphs than the sketch can hold, and larger sketches of both are tried up to a size; should the last
one fail too, the digest sets are compared directly, which gives the same number. The likeness of two fingerprints is shared over all
distinct paragraphs, which the sizes and the number of recovered digests give exactly.

Everything of one document happens in its row. No row meets another except for ``with_next``, which
finds each document's successor inside ranges of ids, with one shuffle of the texts.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of the fingerprint itself; a multiple of three.
CELLS = 30
#: Retries have RETRY cells per possible difference, then twice as many.
RETRY = 1.8
PEEL_ROUNDS = 24
#: Retries that would need more cells are left out, as comparing the digest sets gives the same number.
MOST_CELLS = 100
PARAGRAPH_END = r"\n+"
#: Ends of pieces of lines: white space behind a sentence mark with up to three other marks, or behind fixed word endings.
PIECE_END = r"\n+|(?<=[.!?]\W{0,3})\s+|(?<=[a-z][dgmpz]|[%#])\s+"

CELL = "struct<cell:int,n:int,key:bigint,check:bigint>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def paragraph_digests(text: Column, end: str = PARAGRAPH_END) -> Column:
    """Distinct 64-bit digests of the non-empty paragraphs; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), end)
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.xxhash64(p)))


def _checksum(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(3)).bitwiseAND(F.lit(0xFFFFFFFF))


def _entries(digest: Column, sign: Column, cells: Column) -> Column:
    """What a digest adds to its three cells."""
    part = F.floor(cells / 3).cast("int")

    def three(check: Column) -> Column:
        def entry(k: int) -> Column:
            cell = F.pmod(F.xxhash64(digest, F.lit(k)), part).cast("int") + part * k
            return F.struct(cell.alias("cell"), sign.cast("int").alias("n"), digest.alias("key"), check.alias("check"))

        return F.array(entry(0), entry(1), entry(2))

    return _let(_checksum(digest), three)


def _folded(entries: Column) -> Column:
    """Adds up the entries of each cell; cells that come to nothing are left out."""

    def fold(line: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(line)),
            lambda i: (i == 1) | (F.element_at(line, i)["cell"] != F.element_at(line, F.greatest(i - 1, F.lit(1)))["cell"]),
        )

        def cell_of(all_starts: Column) -> Column:
            def total(start: Column, at: Column) -> Column:
                end = F.coalesce(F.get(all_starts, at + 1), F.size(line) + 1)
                alone = F.element_at(line, start)
                zero = F.struct(
                    F.element_at(line, start)["cell"].alias("cell"),
                    F.lit(0).alias("n"),
                    F.lit(0).cast("bigint").alias("key"),
                    F.lit(0).cast("bigint").alias("check"),
                )
                several = F.aggregate(
                    F.slice(line, start, end - start),
                    zero,
                    lambda acc, x: F.struct(
                        acc["cell"].alias("cell"),
                        (acc["n"] + x["n"]).alias("n"),
                        acc["key"].bitwiseXOR(x["key"]).alias("key"),
                        acc["check"].bitwiseXOR(x["check"]).alias("check"),
                    ),
                )
                return F.when(end == start + 1, alone).otherwise(several)

            return F.transform(all_starts, total)

        cells = F.filter(_let(starts, cell_of), lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0))
        return F.when(F.size(line) == 0, F.array().cast(f"array<{CELL}>")).otherwise(cells)

    return _let(F.sort_array(entries), fold)


def sketch(digests: Column, cells: Column) -> Column:
    """The cells in use of a sketch with ``cells`` cells (a multiple of three)."""
    return _folded(F.flatten(F.transform(digests, lambda d: _entries(d, F.lit(1), cells))))


def difference_sketch(a: Column, b: Column, cells: Column) -> Column:
    """The same as ``subtracted(sketch(a, cells), sketch(b, cells))``, added up once."""
    return _folded(
        F.concat(
            F.flatten(F.transform(a, lambda d: _entries(d, F.lit(1), cells))),
            F.flatten(F.transform(b, lambda d: _entries(d, F.lit(-1), cells))),
        )
    )


def subtracted(a: Column, b: Column) -> Column:
    negative = F.transform(
        b, lambda c: F.struct(c["cell"].alias("cell"), (-c["n"]).alias("n"), c["key"].alias("key"), c["check"].alias("check"))
    )
    return _folded(F.concat(a, negative))


def peeled(cells: Column, size: Column) -> Column:
    """(cells that remain, digests found with their sign) of a subtracted sketch of ``size`` cells.

    Sign 1: only in the first text; -1: only in the second.
    """
    nothing = F.array().cast("array<struct<key:bigint,sign:int>>")

    def round_(state: Column, _: Column) -> Column:
        pure = F.array_distinct(
            F.transform(
                F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _checksum(c["key"]))),
                lambda c: F.struct(c["key"].alias("key"), c["n"].alias("sign")),
            )
        )

        def taken(found: Column) -> Column:
            away = F.flatten(F.transform(found, lambda f: _entries(f["key"], -f["sign"], size)))
            left = F.when(F.size(found) == 0, state["cells"]).otherwise(_folded(F.concat(state["cells"], away)))
            more = F.size(found) > 0
            return F.struct(left.alias("cells"), F.concat(state["found"], found).alias("found"), more.alias("more"))

        return F.when(state["more"] & (F.size(state["cells"]) > 0), _let(pure, taken)).otherwise(state)

    start = F.struct(cells.alias("cells"), nothing.alias("found"), F.lit(True).alias("more"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(PEEL_ROUNDS)), start, round_)


def _difference(cells: Column, size: Column) -> Column:
    """How many digests a subtracted sketch of ``size`` cells holds; null if it can't be peeled to the end."""
    return _let(peeled(cells, size), lambda s: F.when(F.size(s["cells"]) == 0, F.size(s["found"])))


def likeness(digests_a: Column, digests_b: Column, cells_a: Column, cells_b: Column, cells: int = CELLS) -> Column:
    """Shared over all distinct paragraphs of two texts, from their sketches; 1 if neither has any."""
    both = F.size(digests_a) + F.size(digests_b)
    first = (F.ceil(both * F.lit(RETRY) / 3) * 3).cast("int") + F.lit(cells)

    def retry(size: Column) -> Column:
        return _let(size, lambda m: F.when(m <= MOST_CELLS, _difference(difference_sketch(digests_a, digests_b, m), m)))

    exact = F.size(F.array_except(digests_a, digests_b)) + F.size(F.array_except(digests_b, digests_a))
    differ = F.coalesce(_difference(subtracted(cells_a, cells_b), F.lit(cells)), retry(first), retry(first * 2), exact)
    return F.when(both == 0, F.lit(1.0)).otherwise(_let(differ, lambda d: (both - d) / (both + d)))


def written(digests: Column, cells: Column) -> Column:
    """A sketch as text: the number of paragraphs, then cell, count, digests and checksums in hex."""
    one = F.transform(
        cells,
        lambda c: F.concat(
            F.lpad(F.hex(c["cell"]), 2, "0"), F.lpad(F.hex(c["n"]), 4, "0"), F.lpad(F.hex(c["key"]), 16, "0"), F.lpad(F.hex(c["check"]), 8, "0")
        ),
    )
    return F.concat(F.size(digests).cast("string"), F.lit(":"), F.array_join(one, ""))


#: Bytes of text aimed at per range of ids, and the most ranges; larger ranges are sorted with spilling.
RANGE_BYTES = 4 << 20
MOST_RANGES = 4096


def _range_of(doc_id: Column, splits: list[int]) -> Column:
    """How many of the sorted ``splits`` are below the id: a binary search."""
    if not splits:
        return F.lit(0)
    depth = ceil(log2(len(splits) + 1))
    padded = F.lit([*splits, *[splits[-1]] * (2**depth - 1 - len(splits))])
    steps = F.lit([2**k for k in reversed(range(depth))])
    return F.aggregate(steps, F.lit(0), lambda low, s: F.when(F.element_at(padded, low + s) < doc_id, low + s).otherwise(low))


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, text and next_text: the text behind each in descending order of ids, the first behind the last.

    Rows of equal id follow each other in the order of their texts. Rows without id come behind no
    row and have no next text. The first row of each range is repeated, marked, at the end of the
    range before it, so that the window of a range finds the successor of its last row.
    """
    held = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = min(MOST_RANGES, max(1, ceil(size / range_bytes)))
    points = [i / count for i in range(1, count)]
    known = held.where("doc_id IS NOT NULL").select("doc_id")
    splits = sorted({int(x) for x in known.approxQuantile("doc_id", points, 0.2 / count)}) if points else []
    ranged = held.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_range_of(F.col("doc_id"), splits)))
    firsts = ranged.where("range >= 0").groupBy("range").agg(F.max("doc_id").alias("doc_id"))
    chain = Window.orderBy("range")  # one row per range, MOST_RANGES at most
    above = firsts.select("doc_id", F.lead("range").over(chain).alias("_up"), F.first("range").over(chain).alias("_lowest"))
    # the highest range's first row follows the lowest range's last row
    guards = ranged.drop("range").join(
        F.broadcast(above.select("doc_id", F.coalesce("_up", "_lowest").alias("range"))), "doc_id"
    )
    rows = ranged.withColumn("guard", F.lit(0)).unionByName(guards.withColumn("guard", F.lit(1)))
    line = Window.partitionBy("range").orderBy("guard", F.desc("doc_id"), "text")
    found = rows.withColumn("next_text", F.lead("text").over(line)).where("guard = 0")
    return found.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.col("next_text")).alias("next_text"))


def fingerprints(docs: DataFrame, cells: int = CELLS, end: str = PARAGRAPH_END) -> DataFrame:
    """Fingerprints of each text of (doc_id, text), of its edited text, and their likenesses.

    The edit replaces the last floor(n / 2) of n code points by as many (or all) first ones of the
    next text (see `with_next`). A null text is empty; an empty text has the fingerprint ``0:``. Two
    empty texts are alike (1), an empty and another text are not (0). Repeated rows are separate
    documents. ``end`` is the pattern that paragraphs end with. Other columns are ignored; an empty
    table gives an empty result.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half),
    )
    texts = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited)
    hashed = texts.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        paragraph_digests(F.col("text"), end).alias("own"),
        paragraph_digests(F.col("edited"), end).alias("changed"),
        paragraph_digests(F.col("next_text"), end).alias("following"),
    )
    sketched = hashed.withColumns(
        {f"{c}_cells": sketch(F.col(c), F.lit(cells)) for c in ("own", "changed", "following")}
    )
    own, own_cells = F.col("own"), F.col("own_cells")
    return sketched.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(own, own_cells).alias("fingerprint"),
        written(F.col("changed"), F.col("changed_cells")).alias("edited_fingerprint"),
        likeness(own, F.col("changed"), own_cells, F.col("changed_cells"), cells).alias("near_edited"),
        likeness(own, F.col("following"), own_cells, F.col("following_cells"), cells).alias("near_next"),
    )
