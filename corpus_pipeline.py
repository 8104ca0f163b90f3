"""A corpus cleaned in stages, each written as Parquet and read again by the next one.

Rejected by quality, cleaned of boilerplate lines, one document per group of near duplicates,
without benchmark items, and encoded. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.llm.common import Settled, settle, table
from accesslens.llm.decontamination import find_items
from accesslens.llm.line_dedup import drop_boilerplate_lines
from accesslens.llm.mil_quality import score, train
from accesslens.llm.queries import encoded_digests
from accesslens.llm.sketch_dedup import near_duplicates


def unused(name: str, docs: DataFrame) -> str:
    """A column name that `docs` has not."""
    taken = {column.lower() for column in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a key of each row (doc_id may be NULL or repeated) and the key's name; written
    once so that the key stays the same whenever it is read."""
    key = unused("_row_key", docs)
    return settle(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def without(rows: DataFrame, key: str, gone: DataFrame, purpose: str) -> DataFrame:
    """The rows whose key is not in `gone`, without the key."""
    return rows.join(Settled(gone, purpose).side(), key, "left_anti").drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the quality classifier go."""
    judged = unused("_quality", docs)
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), score_col=judged)
    return scored.where(F.col(judged) >= 0.5).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, documents stay: `text` and `n_chars` are those of the cleaned text."""
    cleaned = drop_boilerplate_lines(docs)
    columns = []
    for name, kind in docs.dtypes:
        value = F.col("row").getField(name)
        if name == "text":
            value = F.col("text")
        elif name == "n_chars":
            value = F.char_length("text").cast(kind)
        columns.append(value.alias(name))
    return cleaned.select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one with the smallest doc_id, NULL last.

    Rows that repeat a doc_id are told apart; rows without words are in no group and stay.
    """
    rows, key = keyed(docs)
    found = near_duplicates(rows, id_col=key)
    groups = found.select(F.col(key).alias("member"), F.col("component_id").alias("group"))
    ranked = rows.select(F.col(key).alias("key"), "doc_id").join(groups, F.col("key") == F.col("member"))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")
    first = ranked.groupBy("group").agg(F.min(order).getField("key").alias("first"))
    dropped = found.select(key).join(first.select("first"), F.col(key) == F.col("first"), "left_anti")
    return without(rows, key, dropped, "dropped")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains a benchmark item go, whatever other rows have the same doc_id."""
    rows, key = keyed(docs)
    hits = find_items(rows, table(spark, sf_dir, "benchmark"), id_col=key)
    return without(rows, key, hits.select(key).distinct(), "contaminated")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of token ids and decoded text, per document."""
    return encoded_digests(docs.select("doc_id", "text")).drop("text")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encoding),
]

#: A trained model takes part, which SQL cannot express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
