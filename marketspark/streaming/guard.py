"""A lost stream stops trading; typed streams meet in one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class DisconnectGuard(StreamingQueryListener):
    """Calls ``trip(cause, detail)`` when a query ends with an error. Register with spark.streams.addListener."""

    def __init__(self, trip: Callable[[str, str], None]):
        self.trip = trip

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.trip("websocket_disconnected", str(event.exception)[:500])


def merged(**streams: DataFrame) -> DataFrame:
    """One stream of several, each row with the name of its own in ``kind``; columns that one lacks are NULL."""
    tagged = [df.withColumn("kind", F.lit(name)) for name, df in streams.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
