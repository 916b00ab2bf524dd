"""Progress of streams and of batch plans, told to a callback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls ``tell(batch number, rows of the batch, name)`` after every micro-batch."""

    def __init__(self, tell: Callable[[int, int, str | None], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.tell(event.progress.batchId, event.progress.numInputRows, event.progress.name)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def observed(rows: DataFrame, flag: str = "success") -> tuple[DataFrame, Observation]:
    """``rows`` with counters that are filled while the plan runs: all rows, and those whose flag is true."""
    counters = Observation()
    return rows.observe(counters, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(flag)).alias("good")), counters
