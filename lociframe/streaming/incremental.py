"""Incremental use of the embedding store from a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Embedder, embed_missing


def embed_stream(texts: DataFrame, text: str, store: str, fn: Embedder, checkpoint: str, level: str = "seq", pooling: str = "mean") -> StreamingQuery:
    """Embeds what a stream brings that the store lacks, all that is there now, a micro-batch at a time.

    A micro-batch that is run again after a failure finds its keys in the store and adds nothing.
    """

    def one(batch: DataFrame, _: int) -> None:
        embed_missing(batch, text, store, fn, level, pooling)

    return texts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
