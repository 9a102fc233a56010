"""A stream of changes into an index.

Each micro-batch is one upsert and one delete. Its number is kept in the index's manifest with the change, so a batch
that a restarted query sends again changes nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.index import VectorIndex, last_of_each


def apply_changes(index: VectorIndex, batch: DataFrame, number: int, stream: str = "stream", order_col: str | None = None, deleted_col: str | None = None) -> None:
    """The last change of each id by order_col holds. A change whose deleted_col is true removes the row."""
    own = index.id_col
    if order_col:
        batch = last_of_each(batch, own, F.col(order_col))
    if deleted_col:
        # First what goes: a repeat of it does no harm, and the numbered upsert ends the batch.
        gone = batch.where(F.coalesce(F.col(deleted_col), F.lit(False)))
        if not gone.isEmpty():
            index.delete(gone.select(own))
        batch = batch.where(~F.coalesce(F.col(deleted_col), F.lit(False)))
    index.upsert(batch, (stream, number))


def ingest(changes: DataFrame, index: VectorIndex, stream: str = "stream", order_col: str | None = None, deleted_col: str | None = None, compact_every: int = 50) -> DataStreamWriter:
    """A writer to start: set a checkpoint location and a trigger first. Parts are merged now and then. One stream writes to
    an index at a time; a change by another writer meanwhile fails the batch, which is sent again."""

    def one(batch: DataFrame, number: int) -> None:
        session_index = VectorIndex(batch.sparkSession, index.path)
        apply_changes(session_index, batch, number, stream, order_col, deleted_col)
        if compact_every and (number + 1) % compact_every == 0:
            session_index.drop_unused()  # of the merge before this one, which readers have long left
            session_index.compact()

    return changes.writeStream.foreachBatch(one)
