"""The landing folder as a stream: two scheduled (available-now) runs."""

import os

from pyspark.sql import functions as F

from ledgerlake.operators import pages as P
from ledgerlake.plans.invoice_job import JobOptions
from ledgerlake.streaming.landing import start_landing_job
from test_invoice_job import PAGE1, PAGE2


def test_landing_stream(spark, tmp_path):
    land, out, ck = str(tmp_path / "land"), str(tmp_path / "out"), str(tmp_path / "ck")
    os.makedirs(land)
    with open(os.path.join(land, "a.pdf"), "wb") as f:
        f.write((PAGE1 + "\f" + PAGE2).encode())
    opts = JobOptions(partitions=2)
    q = start_landing_job(spark, land, out, P.text_decoder, P.identity_recogniser,
                          options=opts, checkpoint_location=ck, available_now=True)
    q.awaitTermination(300)
    assert spark.read.parquet(os.path.join(out, "invoice_flat")).count() == 2
    with open(os.path.join(land, "b.png"), "wb") as f:
        f.write((PAGE1 + "\n" + PAGE2.replace("Steel bolt", "Washer")).encode())
    q = start_landing_job(spark, land, out, P.text_decoder, P.identity_recogniser,
                          options=opts, checkpoint_location=ck, available_now=True)
    q.awaitTermination(300)
    flat = spark.read.parquet(os.path.join(out, "invoice_flat"))
    assert flat.count() == 4
    assert flat.filter(F.col("description") == "Washer").count() == 1
