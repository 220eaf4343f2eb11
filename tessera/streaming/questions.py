"""Answering a stream of questions against a fixed corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators import service
from ..operators.sufficiency import Model


def answer_stream(questions: DataFrame, passages: DataFrame, model: Model, path: str, checkpoint: str, limit: int = 5) -> DataStreamWriter:
    """A writer that answers each micro-batch of questions and keeps the answers by batch.

    A batch that is tried again after a failure overwrites its own folder, so
    answers are neither lost nor doubled.
    """

    def run(batch: DataFrame, number: int) -> None:
        service.answer(passages, batch, model, limit).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
