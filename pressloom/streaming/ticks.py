"""Dump ticks as a streaming source with its own offsets, and a sink that a batch may reach twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

STEP = timedelta(minutes=15)
FORM = "%Y%m%d%H%M%S"


class Ticks(InputPartition):
    def __init__(self, ticks: list[str]) -> None:
        self.ticks = ticks


class TickReader(DataSourceStreamReader):
    """Ticks after the cursor in strictly rising order, each once: the offset is the last tick that was handed out.

    A tick of which no stream was published is left out once it is `hole` minutes old; a younger one holds up all that
    follow. A batch takes `most` ticks.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.cursor, self.latest, self.now = (datetime.strptime(options[k], FORM) for k in ("cursor", "latest", "now"))
        self.missing = set(filter(None, options.get("missing", "").split(",")))
        self.most, self.hole = int(options.get("most", 24)), timedelta(minutes=int(options.get("hole", 90)))
        self.at: datetime | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"tick": self.cursor.strftime(FORM)}

    def latestOffset(self) -> dict:  # noqa: N802
        at = self.at or self.cursor
        for _ in range(self.most):
            then = at + STEP
            if then > self.latest or then.strftime(FORM) in self.missing and self.now - then < self.hole:
                break
            at = then
        self.at = at
        return {"tick": at.strftime(FORM)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = (datetime.strptime(x["tick"], FORM) for x in (start, end))
        self.at = max(self.at or b, b)
        ticks = [(a + k * STEP).strftime(FORM) for k in range(1, (b - a) // STEP + 1)]
        return [Ticks([t for t in ticks if t not in self.missing])]

    def read(self, partition: Ticks) -> Iterator[tuple]:
        yield from ((t,) for t in partition.ticks)

    def commit(self, end: dict) -> None:
        pass


class TickSource(DataSource):
    """Options: cursor, latest, now (yyyyMMddHHmmss), missing (ticks by comma), most, hole."""

    @classmethod
    def name(cls) -> str:
        return "dump_ticks"

    def schema(self) -> str:
        return "tick string"

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return TickReader(dict(self.options))


def once_per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: a batch that is run again replaces what it wrote before, so overlapping and repeated runs leave each row once."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
