"""T3-T5, E1-E3, N1-N6."""

import json

from pyspark.sql import functions as F

from helpers import responses
from ledgerlake.functions import normalise as N
from ledgerlake.operators import model as M
from ledgerlake.operators import prompt as PR
from ledgerlake.operators import reshape
from ledgerlake.operators.extract import extract_records

INVOICE_TEXT = """INVOICE
No: INV-7
Date: 2024-05-06
Vendor: Bolt Co GSTIN 11AAAAA1111A1Z1
Bill To: Nut Ltd GSTIN 22BBBBB2222B2Z2
Item Steel bolt 4 x 2.50 10.00
Item Nut 1 x 5.00 5.00
Subtotal 15.00
GST 10% 1.50
Total EUR 16.50"""


def test_prompts(spark):
    df = spark.createDataFrame([("a", 'text "q"\nline', "USD"), ("b", "t", None)], "k string, t string, h string")
    rows = {r.k: r for r in df.select("k", PR.json_prompt(F.col("t"), F.col("h")).alias("pj"),
                                      PR.plain_prompt(F.col("t"), F.col("h")).alias("pp")).collect()}
    pa = json.loads(rows["a"].pj)
    assert pa["text"] == 'text "q"\nline' and pa["schema"]["currency"] == "USD"
    assert pa["schema"]["subtotal"] is None and pa["examples"][0]["output"]["total"] == 224
    assert json.loads(rows["b"].pj)["schema"]["currency"] == ""
    assert rows["a"].pp.endswith('text "q"\nline') and '"currency": "USD"' in rows["a"].pp
    assert '"currency": ""' in rows["b"].pp


def test_rule_extract_fixture(spark):
    df = spark.createDataFrame([(INVOICE_TEXT,)], "t string")
    inv = df.select(M.rule_extract(F.col("t")).alias("i")).collect()[0].i
    assert (inv.vendor_name, inv.invoice_number, inv.invoice_date, inv.currency) == ("Bolt Co", "INV-7", "2024-05-06", "EUR")
    assert (inv.subtotal, inv.tax_percent, inv.tax_amount, inv.total) == (15.0, 10.0, 1.5, 16.5)
    assert [tuple(x) for x in inv.line_items] == [("Steel bolt", 4.0, 2.5, 10.0), ("Nut", 1.0, 5.0, 5.0)]
    # the rule response goes through repair and validation unchanged
    resp = df.select(F.lit("p").alias("path"), M.rule_response(F.col("t")).alias("response"))
    r = extract_records(resp, error=None).collect()[0]
    assert r.json_status == "ok" and r.valid and r.invoice.total == 16.5


def test_model_job_errors(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "k long, prompt string")

    def factory():
        def call(p):
            if int(p[1:]) % 3 == 0:
                raise TimeoutError("slow")
            return '{"notes": "%s"}' % p
        return call
    out = {r.k: r for r in M.model_job(prompts, factory, key="k").collect()}
    assert out[3].response is None and out[3].error.startswith("TimeoutError")
    assert out[4].response == '{"notes": "p4"}' and out[4].error is None
    recs = {r.k: r for r in extract_records(M.model_job(prompts, factory, key="k")).collect()}
    assert recs[3].json_status == "api_error" and recs[3].valid is False
    assert recs[4].json_status == "ok" and recs[4].invoice.notes == "p4"


def test_normalisers(spark):
    df = spark.createDataFrame([
        ("₹1,234.50", "05/01/1997", "  Unit 5 \r\n\n NATION_3\n", "   "),
        ("USD 18%", "Jan 5, 1997", "a, b", "x"),
        ("$2,000", "5 January 1997", "one", None),
    ], "n string, d string, a string, u string")
    got = df.select(N.clean_number(F.col("n")).alias("n"), N.iso_date(F.col("d")).alias("d"),
                    N.one_line_address(F.col("a")).alias("a"), N.unknown_to_null(F.col("u")).alias("u")).collect()
    assert [r.n for r in got] == [1234.5, 18.0, 2000.0]
    assert [r.d for r in got] == ["1997-01-05", "1997-01-05", "1997-01-05"]
    assert [r.a for r in got] == ["Unit 5, NATION_3", "a, b", "one"]
    assert [r.u for r in got] == [None, "x", None]


def test_clean_validation(spark):
    from helpers import responses
    rec = '{"subtotal": "$1,200.50", "tax_percent": "18 %", "total": "EUR 9", "invoice_date": "5 January 1997", ' \
          '"due_date": "soon", "buyer_address": "a\\n b ", "notes": "  ", "line_items": [{"amount": "1,000"}]}'
    plain, clean = (extract_records(responses(spark, [rec]), clean=c).collect()[0] for c in (False, True))
    assert not plain.valid and clean.valid
    assert (clean.invoice.subtotal, clean.invoice.tax_percent, clean.invoice.total) == (1200.5, 18.0, 9.0)
    assert clean.invoice.line_items[0].amount == 1000.0
    inv = extract_records(responses(spark, [rec]), clean=True).select(N.clean_invoice(F.col("invoice")).alias("i")).collect()[0].i
    assert (inv.invoice_date, inv.due_date, inv.buyer_address, inv.notes, inv.total) == ("1997-01-05", "soon", "a, b", None, 9.0)


def test_currency_code_without_total_code(spark):
    df = spark.createDataFrame([("Total 16.50\nall in GBP",), ("Total 16.50",), ("Total EUR 16.50\nGBP",)], "t string")
    got = [r.i.currency for r in df.select(M.rule_extract(F.col("t"), F.lit("CHF")).alias("i")).collect()]
    assert got == ["GBP", "CHF", "EUR"]


def test_grounded_by_words_and_numbers(spark):
    text = "Steel-Bolt,\n   large  4 x 2.50\t10.00\nÉcrou  1 1,200.5 -3"
    items = [("steel bolt large", 4.0, 2.5, 10.0, True, True), ("Bolt, LARGE", None, None, None, True, True), ("olt large", 4.0, None, 10.01, False, False),
             ("large bolt", 2.0, None, None, False, False), ("écrou", 1.0, 1200.5, -3.0, True, True), ("", None, 5.0, None, True, False),
             (None, 1.0, None, None, None, True)]
    import json
    record = json.dumps({"line_items": [dict(zip(("description", "quantity", "unit_price", "amount"), i)) for i in items if i[0] is not None]})
    recs = extract_records(responses(spark, [record])).withColumn("text", F.lit(text))
    got = reshape.items_table(recs, with_line_no=True, text="text").orderBy("line_no").collect()
    assert [(r.grounded, r.numbers_grounded) for r in got] == [i[4:] for i in items if i[0] is not None]
    assert items_of(spark, None) == [(None, None)] and items_of(spark, "") == [(False, False)]


def items_of(spark, text):
    recs = extract_records(responses(spark, ['{"line_items":[{"description":"a","amount":1}]}'])).withColumn("text", F.lit(text).cast("string"))
    return [(r.grounded, r.numbers_grounded) for r in reshape.items_table(recs, text="text").collect()]


def test_model_job_concurrency_retries_and_fail(spark):
    import pytest
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "k long, prompt string")

    def flaky_factory():
        seen = {}

        def call(p):
            seen[p] = seen.get(p, 0) + 1
            if seen[p] == 1 and int(p[1:]) % 2 == 0:
                raise ConnectionError("first try fails")
            return p.upper()
        return call
    out = {r.k: r for r in M.model_job(prompts, flaky_factory, key="k", concurrency=4,
                                       retries=1, backoff_sec=0.01).collect()}
    assert all(out[i].response == f"P{i}" and out[i].error is None for i in range(20))
    no_retry = {r.k: r for r in M.model_job(prompts, flaky_factory, key="k", concurrency=4).collect()}
    assert no_retry[2].error.startswith("ConnectionError") and no_retry[3].response == "P3"

    def broken():
        def call(p):
            raise RuntimeError("down")
        return call
    with pytest.raises(Exception):
        M.model_job(prompts, broken, key="k", on_error="fail").collect()


def test_pretty_json(spark):
    from helpers import responses
    from ledgerlake.sinks import writers
    recs = extract_records(responses(spark, ['{"vendor_name": "Vé", "total": 1}']))
    text = writers.pretty_json(recs).collect()[0].json
    assert "\n" in text
    parsed = json.loads(text)
    assert parsed["vendor_name"] == "Vé" and parsed["total"] == 1.0 and parsed["notes"] is None
