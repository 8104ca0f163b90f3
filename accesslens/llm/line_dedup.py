"""Boilerplate lines by site-relative frequency.

Pages are grouped by host; for each line the pages of the host that contain it are divided by
the host's page total, and lines above a ratio go. Pages of a host with the same text count as
one page, so that a much copied page does not turn its own lines into boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Settled, join_by_group, settle

#: Share of a host's pages above which a line is boilerplate.
RATIO = 0.05
#: Pages a line must be on before its share means anything; small hosts have no statistics.
MIN_PAGES = 5

_BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(_BLANKS))


def boilerplate(
    docs: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(host, keys): hashes of each host's boilerplate lines.

    A host has fewer than (lines per page) / ratio of them. Counts combine before they are
    shuffled, so a host or a line with a third of all rows is one row per task. The host's
    total rides along as the NULL line of each page.
    """
    kept = F.filter(_lines(text), lambda line: _bare(line) != "")
    keys = F.array_distinct(F.transform(kept, lambda line: F.xxhash64(_bare(line))))
    whole = F.coalesce(text, F.lit(""))
    pages = docs.select(
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.xxhash64(whole).alias("page"),
        F.octet_length(whole).alias("size"),
        keys.alias("keys"),
    ).groupBy("host", "page", "size").agg(F.first("keys").alias("keys"))
    with_total = F.concat(F.array(F.lit(None).cast("bigint")), F.col("keys"))
    counts = settle(
        pages.select("host", F.explode(with_total).alias("key"))
        .groupBy("host", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") >= min_pages) | F.col("key").isNull()),
        "line-counts",
    )
    totals = counts.where(F.col("key").isNull()).select("host", F.col("n").alias("total"))
    return (
        counts.where(F.col("key").isNotNull())
        .join(totals, "host")
        .where(F.col("n") / F.col("total") > ratio)
        .groupBy("host")
        .agg(F.collect_set("key").alias("keys"))
    )


def drop_boilerplate_lines(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """Every row of `docs` as (row, text, n_lines, n_dropped); `row` holds all its columns.

    Lines are parted by LF and compared without blanks around them; blank lines stay. A line
    goes when it is on at least `min_pages` distinct pages of the host and on more than `ratio`
    of them. NULL texts count as empty, NULL hosts as one host named ''. An empty table gives an
    empty result; repeated rows are one page and are all cleaned.
    """
    rows = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
    )
    found = Settled(
        boilerplate(docs, F.col(host_col), F.col(text_col), ratio, min_pages), "boilerplate"
    )
    text = F.col("row").getField(text_col)
    joined = join_by_group(rows, found, "host", lambda: F.xxhash64("row"))
    none = F.array().cast("array<bigint>")
    parted = joined.select(
        "row", _lines(text).alias("lines"), F.coalesce("keys", none).alias("keys")
    )
    good = F.filter(
        F.col("lines"), lambda line: ~F.array_contains(F.col("keys"), F.xxhash64(_bare(line)))
    )
    kept = parted.select("row", F.size("lines").cast("bigint").alias("n_lines"),
                         F.when(F.size("keys") == 0, F.col("lines")).otherwise(good).alias("kept"))
    return kept.select(
        "row",
        F.array_join("kept", "\n").alias("text"),
        "n_lines",
        (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
    )
