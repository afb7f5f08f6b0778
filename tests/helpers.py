"""Small helpers shared by the tests."""

import json

from pyspark.sql import functions as F


def responses(spark, texts):
    rows = [(f"f{i}", t, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "path string, response string, error string")


def raw_json(df):
    """path -> (json_status, python value of raw)."""
    out = {}
    for r in df.select("path", "json_status", F.to_json("raw").alias("j")).collect():
        out[r.path] = (r.json_status, json.loads(r.j) if r.j is not None else None)
    return out
