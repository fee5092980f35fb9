"""Documents that arrive as a stream, brought into a store batch by batch.

Of each micro-batch the last row of a document_id counts; a null text removes its document. The batch is built as a partial corpus: documents
it doesn't hold stay as they are, and nothing but the batch is written. A batch that is delivered again changes nothing: its documents are
unchanged by then."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernstone.plans.engine import Engine
from quernstone.session import cut

CORPUS = ["document_id", "source_uri", "text", "content_hash", "media_type"]


def latest(batch: DataFrame) -> DataFrame:
    """The last row of each document of a batch."""
    order = Window.partitionBy("document_id").orderBy(F.desc("arrived_at"), F.desc("content_hash"))
    return batch.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(*CORPUS)


def start(stream: DataFrame, engine: Engine, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run the stream of documents (CORPUS and arrived_at) into the engine's store."""

    def one(batch: DataFrame, batch_id: int) -> None:
        engine.build(cut(latest(batch), "stream-batch"), f"batch-{batch_id}", partial=True)

    w = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
