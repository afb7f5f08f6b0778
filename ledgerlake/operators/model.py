"""Extraction calls.

`model_job` sends one prompt per document through an injected client, built
once per task; a failed call becomes an `error` (or fails the job with
`on_error='fail'`).  Calls cost money and have side effects, so the responses
should be stored (`store_responses`) before anything downstream can re-plan
and run them again.

`rule_extract` is the offline extractor: native regular expressions for one
line layout, that of the derived invoice texts (number, date, vendor and buyer with tax ids, item
lines `name qty x price amount`, subtotal, tax % and amount, currency and
total).  It produces the same JSON text a model would, so it slots into the
repair and validation stages unchanged.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Client = Callable[[str], str]


def model_job(prompts: DataFrame, client_factory: Callable[[], Client],
              key: str = "path", prompt: str = "prompt",
              on_error: str = "empty", concurrency: int = 1,
              retries: int = 0, backoff_sec: float = 1.0) -> DataFrame:
    """(key, response, error) for every prompt.

    Calls are latency-bound, so a task may keep up to `concurrency` calls in
    flight (threads over one client); a failed call is retried `retries`
    times with exponential backoff before it becomes an `error` (or, with
    `on_error='fail'`, fails the task and so the job).
    """
    if on_error not in ("empty", "fail"):
        raise ValueError("on_error must be 'empty' or 'fail'")
    src = prompts.select(F.col(key).alias("_key"), F.col(prompt).alias("_prompt"))
    schema = f"_key {prompts.schema[key].dataType.simpleString()}, response string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time
        from concurrent.futures import ThreadPoolExecutor

        client = client_factory()

        def one(p):
            for attempt in range(retries + 1):
                try:
                    return client(p), None
                except Exception as e:  # noqa: BLE001
                    if attempt == retries:
                        if on_error == "fail":
                            raise
                        return None, f"{type(e).__name__}: {e}"
                    time.sleep(backoff_sec * (2 ** attempt))

        pool = ThreadPoolExecutor(concurrency) if concurrency > 1 else None
        try:
            for pdf in batches:
                results = list(pool.map(one, pdf["_prompt"]) if pool else map(one, pdf["_prompt"]))
                yield pd.DataFrame({"_key": pdf["_key"],
                                    "response": [r for r, _ in results],
                                    "error": [e for _, e in results]})
        finally:
            if pool:
                pool.shutdown()

    return src.mapInPandas(run, schema).withColumnRenamed("_key", key)


def store_responses(responses: DataFrame, path: str | None = None) -> DataFrame:
    """Persist responses so that later stages never call the model again:
    written as Parquet to `path` (a shared folder), or checkpointed into the
    session's checkpoint folder."""
    if path:
        responses.write.mode("overwrite").parquet(path)
        return responses.sparkSession.read.parquet(path)
    return responses.checkpoint(eager=True)


# --- rule-based extraction ------------------------------------------------------

# The line layout that the rule extractor reads.
_NUM = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
RX_NUMBER = r"(?m)^No:[ \t]*(\S.*?)[ \t]*$"
RX_DATE = r"(?m)^Date:[ \t]*(\S.*?)[ \t]*$"
RX_VENDOR = r"(?m)^Vendor:[ \t]*(.*?)[ \t]+GSTIN[ \t]+(\S+)[ \t]*$"
RX_BUYER = r"(?m)^Bill To:[ \t]*(.*?)[ \t]+GSTIN[ \t]+(\S+)[ \t]*$"
RX_ITEM = r"(?m)^Item[ \t]+(.+?)[ \t]+" + _NUM + r"[ \t]+x[ \t]+" + _NUM + r"[ \t]+" + _NUM + r"[ \t]*$"
RX_SUBTOTAL = r"(?m)^Subtotal[ \t]+" + _NUM + r"[ \t]*$"
RX_TAX = r"(?m)^(?:GST|VAT|Tax)[ \t]+([0-9]+(?:\.[0-9]+)?)%[ \t]+" + _NUM + r"[ \t]*$"
RX_TOTAL = r"(?m)^Total[ \t]+(?:([A-Z]{3})[ \t]+)?" + _NUM + r"[ \t]*$"
CURRENCY_CODES = ["INR", "USD", "EUR", "GBP", "JPY", "AUD", "CAD", "CHF", "CNY", "SGD", "AED"]


def _grab(text: Column, rx: str, idx: int) -> Column:
    return F.nullif(F.regexp_extract(text, rx, idx), F.lit(""))


def _num(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("double")


def currency_code(text: Column, hint: Column | None = None) -> Column:
    """First currency code in the text (N3), else the hint."""
    rx = r"\b(" + "|".join(CURRENCY_CODES) + r")\b"
    found = _grab(text, rx, 1)
    return F.coalesce(found, F.nullif(hint, F.lit(""))) if hint is not None else found


def rule_extract(text: Column, hint: Column | None = None) -> Column:
    """Invoice struct (canonical fields and types) read from the text."""
    # The text is searched once; the groups are then taken from each short line.
    line_items = F.transform(F.regexp_extract_all(text, F.lit(RX_ITEM), 0), lambda line: F.struct(
        F.regexp_extract(line, RX_ITEM, 1).alias("description"), _num(F.regexp_extract(line, RX_ITEM, 2)).alias("quantity"),
        _num(F.regexp_extract(line, RX_ITEM, 3)).alias("unit_price"), _num(F.regexp_extract(line, RX_ITEM, 4)).alias("amount")))
    return F.struct(
        _grab(text, RX_VENDOR, 1).alias("vendor_name"),
        F.lit(None).cast("string").alias("vendor_address"),
        _grab(text, RX_VENDOR, 2).alias("vendor_gstin"),
        _grab(text, RX_NUMBER, 1).alias("invoice_number"),
        _grab(text, RX_DATE, 1).alias("invoice_date"),
        F.lit(None).cast("string").alias("due_date"),
        _grab(text, RX_BUYER, 1).alias("buyer_name"),
        F.lit(None).cast("string").alias("buyer_address"),
        _grab(text, RX_BUYER, 2).alias("buyer_gstin"),
        F.coalesce(_grab(text, RX_TOTAL, 1), currency_code(text, hint)).alias("currency"),
        _num(_grab(text, RX_SUBTOTAL, 1)).alias("subtotal"),
        _num(_grab(text, RX_TAX, 1)).alias("tax_percent"),
        _num(_grab(text, RX_TAX, 2)).alias("tax_amount"),
        _num(_grab(text, RX_TOTAL, 2)).alias("total"),
        line_items.alias("line_items"),
        F.lit(None).cast("string").alias("notes"))


def rule_response(text: Column, hint: Column | None = None) -> Column:
    """`rule_extract` as the JSON text a model would answer with."""
    return F.to_json(rule_extract(text, hint))
