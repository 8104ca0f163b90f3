"""Connected components of a large graph by alternating stars, with joins and minima only.

Large stars and small stars (Kiveris et al., Connected Components in MapReduce and Beyond, 2014)
until nothing changes: every link then leads to the smallest member of its component. The number
of links never grows, a member's links are never gathered, and each round is written to the
shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _links(rows: DataFrame) -> DataFrame:
    """(hi, lo), hi > lo, each once."""
    return (
        rows.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )


def _state(links: DataFrame) -> tuple:
    return tuple(
        links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """(member, component) for every member of an edge (a, b) but a component's smallest itself.

    NULL ends and loops link nothing; an empty graph has no rows.
    """
    links = settle(_links(edges.where("a IS NOT NULL AND b IS NOT NULL")), "links")
    state = _state(links)
    while state[0]:
        both = links.select(F.col("hi").alias("node"), F.col("lo").alias("near")).union(
            links.select(F.col("lo"), F.col("hi"))
        )
        least = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("top"))
        large = _links(
            both.join(least, "node").where("near > node").select(F.col("near").alias("a"), F.col("top").alias("b"))
        )
        lowest = large.groupBy("hi").agg(F.min("lo").alias("top"))
        small = large.join(lowest, "hi").select(
            F.when(F.col("lo") == F.col("top"), F.col("hi")).otherwise(F.col("lo")).alias("a"),
            F.col("top").alias("b"),
        )
        links = settle(_links(small), "links")
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("hi").alias("member"), F.col("lo").alias("component"))
