"""Landing-folder ingestion as a Structured Streaming query.

New files in the folder are picked up by the streaming `binaryFile` source;
each micro-batch runs the batch job's incremental stages (`process_files`)
through `foreachBatch`.  The stream's checkpoint records which files were
offered.  A micro-batch publishes its tables by one last write; if it fails
before that, the stream offers its files again and the repeated batch
publishes them once.  Files whose call or page job failed are published as
failures and not as done: `run_invoice_job` over the folder retries them.
"""

from __future__ import annotations

import os
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.invoice_job import JobOptions, process_files
from ..session import checkpoint_dir, configure
from ..sources.files import read_files, stream_files


def start_landing_job(spark: SparkSession, landing_dir: str, out_dir: str,
                      decoder_factory: Callable, recogniser_factory: Callable,
                      client_factory: Callable | None = None,
                      options: JobOptions | None = None,
                      checkpoint_location: str | None = None,
                      available_now: bool = False,
                      processing_time: str = "1 minute",
                      max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the stream; `available_now=True` processes what is there and
    stops (a scheduled run), otherwise it polls every `processing_time`."""
    configure(spark)
    o = options or JobOptions()
    stream = stream_files(spark, landing_dir, o.extensions, max_files_per_trigger)

    def batch(df: DataFrame, epoch_id: int) -> None:
        process_files(df.sparkSession, df, out_dir, decoder_factory, recogniser_factory,
                      client_factory, o, read_files)

    ckpt = checkpoint_location or os.path.join(checkpoint_dir(spark), "landing",
                                               os.path.basename(os.path.normpath(out_dir)))
    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
