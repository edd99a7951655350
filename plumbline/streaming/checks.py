"""Checks over a stream: each micro-batch is judged and its findings are upserted, as in a batch run."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.run import run
from plumbline.plans.document import Check
from plumbline.sources.guard import Source
from plumbline.sources.state import Store


def start(stream: DataFrame, view: str, others: dict[str, DataFrame], checks: list[Check], store: Store, *, as_of: datetime | Callable[[], datetime] | None = None, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Judges new rows of a view as they arrive.

    A batch's run id follows from its number and from the id that the checkpoint gives the stream, so streams of one store
    don't meet, and a batch that is tried again after a failure is a repeated run: it changes nothing twice. Findings of
    rows that aren't in a batch stay untouched. as_of: the time that now stands for, or what gives it to each batch; without
    one it is the time at which the batch begins. A batch keeps the time of its first try.
    """

    def now() -> datetime:
        return as_of if isinstance(as_of, datetime) else as_of() if as_of else datetime.now(timezone.utc).replace(tzinfo=None)

    def judge(batch: DataFrame, number: int) -> None:
        stream_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        run(Source(batch.sparkSession, {view: batch} | others), store, checks, run_id=f"stream-{stream_id}-{number}", as_of=now(), trigger="stream")

    writer = stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
