"""Streams of query entities held against a static catalogue, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kithlink.config import Config
from kithlink.operators.blocking import run_blocking
from kithlink.operators.normalise import normalise


def link_stream(raw: DataFrame, s2: DataFrame, s3: DataFrame, out: str, checkpoint: str, cfg: Config) -> StreamingQuery:
    """raw: a stream of RAW rows; s2, s3: normalised. Candidates of each batch go to out/batch_id=N, written over on a retry."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        run_blocking(normalise(rows), s2, s3, cfg).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
