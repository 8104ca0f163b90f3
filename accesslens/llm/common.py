"""What the text operators share: words, intermediate tables, size-checked joins."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Parquet bytes up to which a measured table is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Lower-case words between ASCII white space; NULL counts as empty."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda word: word != "")


class Settled:
    """A frame written once to the shared folder: lineage ends here, and its size is known."""

    def __init__(self, frame: DataFrame, purpose: str):
        spark = frame.sparkSession
        self.path = shared_folder(spark, purpose)
        frame.write.parquet(self.path)
        self.frame = spark.read.schema(frame.schema).parquet(self.path)

    def bytes(self) -> int:
        jvm, session = self.frame.sparkSession._jvm, self.frame.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        system = path.getFileSystem(session.sessionState().newHadoopConf())
        return system.getContentSummary(path).getLength()

    def small(self) -> bool:
        return self.bytes() <= BROADCAST_BYTES

    def side(self) -> DataFrame:
        """As the build side of a join: broadcast when it was measured to be small."""
        return F.broadcast(self.frame) if self.small() else self.frame


def settle(frame: DataFrame, purpose: str) -> DataFrame:
    return Settled(frame, purpose).frame


def join_by_group(
    rows: DataFrame, groups: Settled, key: str, spread: Callable[[], Column], salts: int = 64
) -> DataFrame:
    """Left join of rows to one row per group, where one group may own a third of the rows.

    Broadcast when the groups were measured to be small; otherwise the groups are repeated per
    salt and `spread()` deals a group's rows over the salts. The same rows come out either way.
    """
    if groups.small():
        return rows.join(F.broadcast(groups.frame), key, "left")
    salted = rows.withColumn("_salt", F.pmod(spread(), F.lit(salts)).cast("int"))
    copies = groups.frame.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def most_frequent(counts: DataFrame, size: int) -> list[tuple[bytes | str, int]]:
    """(word, n) of the most frequent words, at most `size`, most frequent first, ties by word.

    Counts are found from a histogram of bounded size, so that no task sends more than its share of
    the result (a sorted limit would send `size` per task). Of the first count that does not fit as
    a whole, words are taken by ranges of a hash, so that ties leave out few and never all.
    """
    level = F.when(F.col("n") < 1024, F.col("n").cast("double")).otherwise(F.floor(F.log2("n") * 64) * 1.0 + 1024)
    part = F.pmod(F.xxhash64(F.col("word").cast("string"), F.lit(1)), F.lit(4096)).cast("int")
    levelled = counts.select("word", "n", level.alias("level"), part.alias("part"))
    held, last = 0, None
    fitting = []
    for row in levelled.groupBy("level").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():
        if held + row["words"] > size:
            last = row["level"]
            break
        held += row["words"]
        fitting.append(row["level"])
    wanted = F.col("level") >= min(fitting) if fitting else F.lit(False)
    if last is not None:
        parts = 0
        for row in levelled.where(F.col("level") == last).groupBy("part").count().orderBy("part").collect():
            if held + row["count"] > size:
                break
            held += row["count"]
            parts = row["part"] + 1
        wanted = wanted | ((F.col("level") == last) & (F.col("part") < parts))
    rows = levelled.where(wanted).select("word", "n").collect()
    return sorted(((row["word"], row["n"]) for row in rows), key=lambda x: (-x[1], x[0]))
