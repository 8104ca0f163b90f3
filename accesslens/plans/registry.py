"""Log types and their registry: the place where a new format is added."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import types as T

from ..functions.access_line import access_entry, access_tokens
from ..schema import ACCESS_ENTRY, stored_schema


class LogType(Protocol):
    """One log format.

    Parsing has two steps because of cost, not of meaning: `tokens` does the expensive text
    work once per message, `entry` picks fields out of its result and may read it many times.
    """

    name: str
    entry_schema: T.StructType
    # Optional `lookups`: entry columns that single rows are looked up by (they get Bloom filters).

    def tokens(self, raw: Column) -> Column: ...

    def entry(self, tokens: Column) -> Column:
        """STRUCT as in `entry_schema`, including a `ts`; NULL for a message of another form."""
        ...


@dataclass(frozen=True)
class AccessLogType:
    """Apache-style access lines, Common and Combined."""

    name: str = "apache"  # Fixed value: the log type's name in stored source tables.
    entry_schema: T.StructType = ACCESS_ENTRY
    lookups: tuple[str, ...] = ("remote_host", "path")

    def tokens(self, raw: Column) -> Column:
        return access_tokens(raw)

    def entry(self, tokens: Column) -> Column:
        return access_entry(tokens)


class Registry:
    def __init__(self, *log_types: LogType):
        self._types: dict[str, LogType] = {}
        for log_type in log_types:
            self.register(log_type)

    @classmethod
    def with_defaults(cls) -> Registry:
        return cls(AccessLogType())

    def register(self, log_type: LogType) -> None:
        self._types[log_type.name] = log_type

    def get(self, name: str) -> LogType | None:
        return self._types.get(name)

    def names(self) -> list[str]:
        return sorted(self._types)

    def schemas(self) -> dict[str, T.StructType]:
        """Stored table schema per log type."""
        return {name: stored_schema(self._types[name].entry_schema) for name in self.names()}

    def __iter__(self) -> Iterator[LogType]:
        return iter(self._types[name] for name in self.names())
