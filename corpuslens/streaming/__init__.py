"""The stateless checks over streams of documents.

Checks are functions of a DataFrame of documents; a stream applies them to each
micro-batch, so results are those of a batch run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def check_stream(docs: DataFrame, check: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Writes what ``check`` finds in each micro-batch of ``docs(doc_id, text)`` to the table at ``path``.

    A batch has its own part of the table (column ``batch``), which it replaces: one that
    is run again after a failure leaves its rows once.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
