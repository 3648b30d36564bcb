"""A pub/sub feed with replay as a streaming source.

A feed keeps numbered messages by channel and answers two requests, each a
line over TCP: ``END <channel>`` gives the number of its messages, and
``GET <channel> <from> <to>`` those of that range, one a line.  The stream's
offsets are the numbers by channel.  Spark writes them to its checkpoint
before a micro-batch runs, so a batch that failed asks for the very same
ranges again; nothing is lost or repeated.  Tasks fetch their ranges
themselves, and no message passes through the driver.
"""

from __future__ import annotations

import socket
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "tidemark_feed"
#: Messages that one task fetches, that a micro-batch takes of a channel, and that an Arrow batch holds.
PER_TASK, PER_BATCH, PER_ARROW = 100_000, 10_000_000, 8192
_SCHEMA = "value string, channel string, offset long"


@dataclass
class Range(InputPartition):
    channel: str
    start: int
    end: int


def asked(host: str, port: int, request: str) -> Iterator[str]:
    """The lines of an answer."""
    with socket.create_connection((host, port), timeout=60) as link:
        link.sendall(f"{request}\n".encode())
        link.shutdown(socket.SHUT_WR)
        with link.makefile("r", encoding="utf-8", newline="\n") as lines:
            for line in lines:
                yield line[:-1] if line.endswith("\n") else line


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.host, self.port = options["host"], int(options["port"])
        self.channels = options["channels"].split(",")
        self.per_task, self.per_batch = int(options.get("pertask", PER_TASK)), int(options.get("perbatch", PER_BATCH))
        self.last: dict[str, int] | None = None

    def initialOffset(self) -> dict[str, int]:
        self.last = dict.fromkeys(self.channels, 0)
        return self.last

    def latestOffset(self) -> dict[str, int]:
        ends = {c: int(next(asked(self.host, self.port, f"END {c}"))) for c in self.channels}
        if self.last is not None:
            ends = {c: min(n, self.last.get(c, 0) + self.per_batch) for c, n in ends.items()}
        self.last = ends
        return ends

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        self.last = end
        return [Range(c, lo, min(lo + self.per_task, n)) for c, n in end.items() for lo in range(start.get(c, 0), n, self.per_task)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        lines, at = asked(self.host, self.port, f"GET {partition.channel} {partition.start} {partition.end}"), partition.start
        while at < partition.end:
            part = [x for _, x in zip(range(min(PER_ARROW, partition.end - at)), lines, strict=False)]
            if not part:
                raise OSError(f"{partition.channel} ended before message {partition.end}")
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([partition.channel] * len(part)), pa.array(range(at, at + len(part)), pa.int64())], names=["value", "channel", "offset"])
            at += len(part)

    def commit(self, end: dict[str, int]) -> None:
        """The feed keeps its messages; nothing to do."""


class Feed(DataSource):
    """Options: host, port, channels (by commas), perTask, perBatch."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> FeedReader:
        return FeedReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(Feed)
