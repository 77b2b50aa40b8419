"""ST1: validate a stream of requests, micro-batch by micro-batch.

A batch holds whole addresses and nothing is carried to the next one, so each batch runs
the batch plan in ``foreachBatch`` and there is no state and no watermark. Every batch
owns the folder ``batch_id=N`` of both sinks and replaces it, so a batch that is replayed
after a failure leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alamatika.functions import constants as K
from alamatika.plans.gazetteer import Gazetteer
from alamatika.plans.validate import validate
from alamatika.sources import requests as Q
from alamatika.sources.request_log import LOG_CODEC, log_rows


def process_batch(
    batch: DataFrame, batch_id: int, gazetteer: Gazetteer, log_path: str, reject_path: str,
    default_source: str = K.DEFAULT_SOURCE,
) -> None:
    """Write the log rows and the refused requests of one micro-batch."""
    requests = Q.with_address_ids(batch, f"batch-{batch_id}-row-").persist()  # read twice, released below
    try:
        routed = Q.route(requests, gazetteer.registry, default_source)
        log_rows(validate(requests, gazetteer, default_source)).write.mode("overwrite").option(
            "compression", LOG_CODEC
        ).parquet(
            f"{log_path}/batch_id={batch_id}"
        )
        Q.rejected(routed).select(
            "address_id", "address", "source_code", "http_status", "reject_reason"
        ).write.mode("overwrite").parquet(f"{reject_path}/batch_id={batch_id}")
    finally:
        requests.unpersist()


def start(
    stream: DataFrame, gazetteer: Gazetteer, log_path: str, reject_path: str,
    checkpoint_path: str, default_source: str = K.DEFAULT_SOURCE, **trigger,
) -> StreamingQuery:
    """Start the validator on a stream of (address_id, address, source_code)."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint_path).foreachBatch(
        lambda batch, batch_id: process_batch(
            batch, batch_id, gazetteer, log_path, reject_path, default_source
        )
    )
    return (writer.trigger(**trigger) if trigger else writer).start()

