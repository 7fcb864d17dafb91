"""Continuous ingest: landed payload files into the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from crestline.config import DEFAULT, Config
from crestline.plans.ingest_batch import hold_items, ingest_held
from crestline.sources.raw import stream_landing
from crestline.sources.tables import Store


def ingest_stream(
    spark: SparkSession, landing: str, store: Store, checkpoint: str, cfg: Config = DEFAULT, max_files: int = 1000, name: str = "landing",
    read: Callable[[SparkSession, str, int], DataFrame] = stream_landing,
) -> StreamingQuery:
    """Process all landed files and stop; call again to pick up new ones.

    ``read`` is the reader of the landing's layout: pages, or ``stream_bundles``.

    Every micro-batch is one commit that adds its records to ``held_items`` and
    notes its number, so a batch that is replayed after a failure is recognised
    and left out. When all files are read, one more commit brings the held
    records into the other tables, attributed by the stored job ledger as it
    then is: the merge is done once per call, however many files wait. Records
    of jobs that the ledger does not know yet stay in ``held_items``, and so do
    those of a call that died before its merge, for the next one. The returned
    query has ended.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        hold_items(df, store, (name, batch_id))

    q = (
        read(spark, landing, max_files)
        .writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    ingest_held(store, cfg)
    return q
