"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame operations only.

Each input partition is combined into one run: distinct digests, each with the identifier to keep
and a number of texts. In every round the `fan_in` runs whose numbers differ in the lowest digit
only are exchanged and merged, and the digit goes (run number // fan_in), as in a binomial tree.
A merge reads its runs in the order of digests and compares neighbours: of equal ones the first
stays, with the best identifier and all texts. Equality is verified at every level: SHA-256, byte
length and an independent 64-bit hash of the text must all agree.

No run meets in one task: runs are cut into the same slices of the digest range, in number as the
rows demand, and a slice is merged with the same slice of its partners only. Digests spread evenly
and a run holds each of them once, so that slices are alike whatever copies there are. Every round
is written to the shared folder: a lost executor costs one round at most.

The verdict travels back down the same tree: root to first merged runs, these to documents. A
text owned by a third of all rows thus meets, in any join, at most `fan_in` partitions' worth of
its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, settle

_TEXT = ["digest", "size", "check"]


#: Rows of a run that one task merges, as digests spread evenly.
SLICE_ROWS = 1 << 17


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, size, check, run): the digests of all rows, numbered by input partition."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.octet_length("text").alias("size"),
        F.xxhash64("text").alias("check"),
        F.spark_partition_id().alias("run"),
    )


def _slice(slices: int) -> Column:
    """Which of equal ranges of the first 32 bits a digest is in."""
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint")
    return F.shiftright(head * F.lit(slices), 32).cast("int")


def merge_runs(level: DataFrame, best: Callable[[str], Column], fan_in: int) -> DataFrame:
    """One round: (run, slice, digest, size, check, keep_id, group_size) of `fan_in` times fewer runs."""
    order = Window.partitionBy("run", "slice").orderBy(*_TEXT)
    equal = order.rangeBetween(Window.currentRow, Window.currentRow)
    before = F.lag(F.struct(*_TEXT)).over(order)
    return (
        level.withColumn("run", F.floor(F.col("run") / F.lit(fan_in)).cast("int"))
        .select(
            "run",
            "slice",
            *_TEXT,
            best("keep_id").over(equal).alias("keep_id"),
            F.sum("group_size").over(equal).alias("group_size"),
            before.eqNullSafe(F.struct(*_TEXT)).alias("_again"),
        )
        .where(~F.col("_again"))
        .drop("_again")
    )


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    fan_in: int = 4,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; NULL counts as empty, and empty
    texts equal each other. `keep` says which identifier of a group stays. Rows that repeat an
    identifier and a text all count and share the verdict. A NULL identifier stays only where
    its group has no other. No rows in, no rows out; other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    if fan_in < 2:
        raise ValueError(f"fan_in must be 2 or more, not {fan_in}")
    best = F.min if keep == "smallest" else F.max
    leaves = settle(digest_rows(docs, id_col, text_col), "digests")
    last, rows = leaves.agg(F.max("run"), F.count(F.lit(1))).first()
    slices = max(1, -(-rows // SLICE_ROWS))
    level = (
        leaves.groupBy("run", _slice(slices).alias("slice"), *_TEXT)
        .agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    first = level = settle(merge_runs(level, best, fan_in), "merged-runs")
    left = (last or 0) // fan_in + 1
    while left > 1:
        level = settle(merge_runs(level, best, fan_in), "merged-runs")
        left = (left - 1) // fan_in + 1
    root = level.select(*_TEXT, "keep_id", "group_size")

    resolved = first.select("run", *_TEXT).join(root, _TEXT)
    up = F.floor(F.col("run") / F.lit(fan_in)).cast("int")
    found = leaves.select("id", *_TEXT, up.alias("run")).join(resolved, ["run", *_TEXT])
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
