"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

A short item has a tiny Jaccard similarity to a long document, so one sketch size cannot serve
all documents. Documents are partitioned by the power of two of their number of shingles, and
each partition has a one-permutation sketch with as many bins as keep the share of a document's
shingles that are bin minima above a fixed level, whatever its length. An item is probed with
all its shingles (it is short), bands having one row. With `m` shingles shared at the threshold,
a document is missed with probability (1 - share) ** m; the bins are chosen from the shortest
item so that this is at most `MISS`. Where an item is too short for any such choice, sketches are
complete sets and the search is exact.

Candidates are verified on the whole texts: exact containment of word shingles. Everything is a
DataFrame expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Settled, words

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Largest tolerated chance that a document with an item above the threshold is not proposed.
MISS = 1e-7
#: Doublings of the bins tried before sketches become complete sets.
MOST_DOUBLINGS = 6


def _shingles(parts: Column, k: int, make) -> Column:
    """Shingles of an array column (not of an expression: it is read k times per shingle)."""
    n = F.size(parts)
    many = F.transform(
        F.sequence(F.lit(0), n - k), lambda i: make([F.get(parts, i + j) for j in range(k)])
    )
    # Fewer words than a shingle has: the whole sequence, filled up with NULL.
    few = F.array(make([F.get(parts, F.lit(j)) for j in range(k)]))
    return F.when(n >= k, many).when(n > 0, few)


def _hashes(parts: Column, k: int) -> Column:
    return _shingles(parts, k, lambda w: F.xxhash64(*w))


def _texts(parts: Column, k: int) -> Column:
    return F.array_distinct(_shingles(parts, k, lambda w: F.concat_ws(" ", *w)))


def doublings(fewest: int) -> int | None:
    """How often to double the bins when at least `fewest` shingles are shared; None: complete sets."""
    for d in range(MOST_DOUBLINGS + 1):
        load = 2.0**-d  # shingles per bin, at most
        share = (1 - math.exp(-load)) / load
        if (1 - share) ** fewest <= MISS:
            return d
    return None


def _coordinate(hash_: Column, bits: Column) -> Column:
    """Bin (the low `bits` bits) above 32 bits of rank within the bin, in one non-negative number."""
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - F.lit(1).cast("bigint")
    bin_ = hash_.bitwiseAND(mask)
    return F.shiftleft(bin_, 32).bitwiseOR(F.shiftrightunsigned(hash_, 32))


def find_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
    k: int = SHINGLE_WORDS,
) -> DataFrame:
    """(id, item_id, n_item, n_shared, containment) of every item contained in a document.

    Words are lower-cased (A-Z) and parted by ASCII white space; sets are of distinct k-word
    shingles, of the whole sequence where there are fewer words. So an item of fewer than k words
    is found only as a whole document, never inside a longer one. Containment is the shared
    share of the item's set. NULL or empty texts hold nothing and are held by nothing; rows
    that repeat an identifier give one row per item; an empty table on either side gives none.
    NULL identifiers are identifiers like others. Extra columns are ignored.
    """
    wanted = Settled(
        items.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("w"))
        .select("item_id", F.array_distinct(_hashes(F.col("w"), k)).alias("hashes"),
                _texts(F.col("w"), k).alias("item")),
        "items",
    )
    fewest = wanted.frame.agg(F.min(F.ceil(F.size("hashes") * F.lit(threshold)))).first()[0]
    denser = doublings(max(1, fewest or 1))

    # No filter may read a computed array: Catalyst would push it below the projections and with it
    # the splitting of the text into the loop over shingles. So `part` is never NULL (the join
    # would ask) and arrays are exploded by the outer form (the inner one asks for their size).
    sized = (
        docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
        .select("id", _hashes(F.col("w"), k).alias("all"))
        .select("id", F.array_distinct("all").alias("all"))
        .select("id", "all", F.coalesce(F.floor(F.log2(F.size("all"))).cast("int"), F.lit(0)).alias("part"))
    )
    bits = F.col("part") + F.lit(1 + (denser or 0))
    if denser is None:
        sketches = sized.select(
            "id", "part", F.transform("all", lambda h: _coordinate(h, bits)).alias("sketch")
        )
    else:
        ordered = sized.select(
            "id", "part",
            F.sort_array(F.transform("all", lambda h: _coordinate(h, bits))).alias("all"),
        )
        sketches = ordered.select(
            "id", "part",
            F.filter(
                "all",
                lambda x, i: (i == 0)
                | (F.shiftright(x, 32) != F.shiftright(F.get(F.col("all"), i - 1), 32)),
            ).alias("sketch"),
        )
    # Sizes are below 2 ** 31, so there are at most 31 partitions to probe.
    probes = Settled(
        wanted.frame.select("item_id", F.explode("hashes").alias("h"))
        .select("item_id", "h", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("part"))
        .select("item_id", "part", _coordinate(F.col("h"), bits).alias("coordinate"))
        .distinct(),
        "probes",
    )
    candidates = Settled(
        sketches.select("id", "part", F.explode_outer("sketch").alias("coordinate"))
        .join(probes.side(), ["part", "coordinate"])
        .select("id", "item_id")
        .distinct(),
        "candidates",
    )
    both = candidates.side().select(F.col("id").alias("candidate"), "item_id")
    texts = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(both, F.col("id").eqNullSafe(F.col("candidate")))
        .select("id", "item_id", words(F.col("text")).alias("w"))
        .select("id", "item_id", _texts(F.col("w"), k).alias("shingles"))
        .join(wanted.side().select("item_id", "item").withColumnRenamed("item_id", "of_item"),
              F.col("item_id").eqNullSafe(F.col("of_item")))
    )
    shared = texts.select(
        F.col("id").alias(id_col),
        "item_id",
        F.size("item").cast("bigint").alias("n_item"),
        F.size(F.array_intersect("shingles", "item")).cast("bigint").alias("n_shared"),
    )
    return (
        shared.groupBy(id_col, "item_id")
        .agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
        .where(F.col("containment") >= threshold)
    )
