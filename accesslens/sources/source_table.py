"""The stored table of senders: each edit makes a new version, readers take the newest.

An edit is a compare-and-set. It works on the version it has read, writes its rows into a folder of
their own and then claims the next number with one atomic create, a file under `versions/` that
names the folder. Whoever finds the number taken has lost nobody's change: it reads the newer
version and applies its change to that one. Folders no version names are never read.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.times import utc_now
from ..operators.source_changes import (
    INVALID_IP,
    NAME_REQUIRED,
    UNKNOWN_LOG_TYPE,
    check_changes,
    delete_sources,
    upsert_sources,
)
from ..schema import SOURCES, empty
from .files import Folder

_MESSAGES = {
    UNKNOWN_LOG_TYPE: "no parser is registered for this log type",
    NAME_REQUIRED: "a sender must have a name",
    INVALID_IP: "neither an IPv4 nor an IPv6 address",
}


class ConcurrentEdit(RuntimeError):
    """The table has changed since it was read; read it again and repeat the edit."""


class SourceTable:
    def __init__(self, spark: SparkSession, root: str, log_types: Iterable[str]):
        self._spark = spark
        self._root = root.rstrip("/")
        self._log_types = tuple(sorted(log_types))
        self._versions = Folder(spark, f"{self._root}/versions")
        self._last = threading.local()  # the version that this thread has read or written last

    def version(self) -> int:
        """The newest version, listed anew on every call; 0 is the table before the first edit."""
        return max((int(name) for name in self._versions.names()), default=0)

    def read_version(self, version: int) -> DataFrame:
        if version == 0:
            return empty(self._spark, SOURCES)
        return self._spark.read.schema(SOURCES).parquet(f"{self._root}/data/{self._versions.text(str(version))}")

    def read(self) -> DataFrame:
        """The newest version; empty before the first edit."""
        self._last.version = self.version()
        return self.read_version(self._last.version)

    def read_for_batch(self, query_id: str, batch_id: int) -> DataFrame:
        """The newest version at the first attempt of a micro-batch, and the same at later ones.

        A batch that is run again then routes as before, and replaces exactly what its first
        attempt wrote. One small pin per query is kept, for the batch it is working on.
        """
        path = f"{self._root}/pins/query_id={query_id}"
        pin = self._pinned(path)
        if pin is None or pin["batch_id"] != batch_id:
            version = self.version()
            pins = self._spark.range(1).select(
                F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit(version).alias("version")
            )
            pins.write.mode("overwrite").parquet(path)
            return self.read_version(version)
        return self.read_version(pin["version"])

    def _pinned(self, path: str) -> Row | None:
        if not Folder(self._spark, path).names():
            return None
        return self._spark.read.schema("batch_id BIGINT, version INT").parquet(path).first()

    def write(self, rows: DataFrame, after: int | None = None) -> None:
        """Store the version that follows `after`, by default the one this thread has read last.

        ConcurrentEdit if that is no longer the newest. A thread that has read nothing replaces
        whatever there is. An address must be unique: routing would double its messages.
        """
        per_ip = rows.groupBy("ip").agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("name").alias("names"),
            F.count("log_type").alias("log_types"),
        )
        wrong = per_ip.where("ip IS NULL OR rows > 1 OR names < rows OR log_types < rows").head(5)
        if wrong:
            listed = ", ".join(str(row["ip"]) for row in wrong)
            raise ValueError(f"an address needs one row with a name and a log type; not so: {listed}")
        if after is None:
            after = getattr(self._last, "version", None)
        if after is None:
            after = self.version()
        columns = [F.col(f.name).cast(f.dataType) for f in SOURCES.fields]
        folder = uuid.uuid4().hex
        rows.select(*columns).write.parquet(f"{self._root}/data/{folder}")
        if after != self.version() or not self._versions.claim(str(after + 1), folder):
            raise ConcurrentEdit(f"version {after} is no longer the newest")
        self._last.version = after + 1

    def edit(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the table by `change` of it, again from the newest version if others were faster.

        Whenever one editor has to repeat its change, another one's has been stored.
        """
        while True:
            before = self.version()
            try:
                return self.write(change(self.read_version(before)), after=before)
            except ConcurrentEdit:
                continue

    def upsert(self, changes: DataFrame) -> DataFrame:
        """Apply the valid changes; returns those refused, with their reason."""
        checked = check_changes(changes, self._log_types)
        valid = checked.where("reason IS NULL")
        self.edit(lambda current: upsert_sources(current, valid))
        return checked.where("reason IS NOT NULL")

    def add(self, name: str, ip: str, log_type: str) -> None:
        """Add or update one sender; ValueError says what is wrong with it."""
        change = self._spark.createDataFrame(
            [(ip, name, log_type, utc_now())],
            "ip STRING, name STRING, log_type STRING, requested_at TIMESTAMP_NTZ",
        )
        reason = check_changes(change, self._log_types).first()["reason"]
        if reason is not None:
            raise ValueError(f"{_MESSAGES[reason]}: name={name!r} ip={ip!r} log_type={log_type!r}")
        self.upsert(change)

    def remove(self, ip: str) -> None:
        gone = self._spark.createDataFrame([(ip,)], "ip STRING")
        self.edit(lambda current: delete_sources(current, gone))
