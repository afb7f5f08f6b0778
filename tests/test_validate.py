"""JSON value -> typed record (FIXTURES 3.2, 3.3), and a library
oracle: a pydantic model declared from the same field list."""

import json
import math
from typing import List, Optional

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import responses
from ledgerlake.operators.extract import extract_records, repair_responses, validate_records
from ledgerlake.schema import FIELD_ALIASES, INVOICE_FIELDS, ITEM_FIELDS


def run(spark, values, strict_alias=False):
    texts = [json.dumps(v) for v in values]
    df = extract_records(responses(spark, texts), strict_alias=strict_alias)
    rows = {r.path: r for r in df.collect()}
    return [rows[f"f{i}"] for i in range(len(values))]


def one_float(spark, value):
    r = run(spark, [{"subtotal": value}])[0]
    return r.valid, r.invoice.subtotal


@pytest.mark.parametrize("value,expected", [
    (1, 1.0), (True, 1.0), ("300.0", 300.0), (" 300.0 ", 300.0), ("\t3\n", 3.0), ("1e3", 1000.0),
    ("1E+3", 1000.0), ("+5", 5.0), (".5", 0.5), ("5.", 5.0), ("1_000", 1000.0), ("1_.5", 1.5),
    (None, None), (12345678.9, 12345678.9),
])
def test_float_accepts(spark, value, expected):
    assert one_float(spark, value) == (True, expected)


@pytest.mark.parametrize("value", ["inf", "-Infinity", "nan", "1e400"])
def test_float_nonfinite_is_null(spark, value):
    assert one_float(spark, value) == (True, None)


@pytest.mark.parametrize("value", ["1,200", "18%", "", " ", "1__0", "_1", "0x10", "1f", "1d",
                                   "٣", [], {}])
def test_float_rejects(spark, value):
    valid, _ = one_float(spark, value)
    assert valid is False


def test_absent_float(spark):
    r = run(spark, [{}])[0]
    assert r.valid and r.invoice.subtotal is None and r.invoice.line_items == []


@pytest.mark.parametrize("value,valid,expected", [
    ("", True, ""), (None, True, None), ("x", True, "x"),
    (1, False, None), (1.5, False, None), (True, False, None), ([], False, None), ({}, False, None),
])
def test_string_field(spark, value, valid, expected):
    r = run(spark, [{"invoice_number": value}])[0]
    assert r.valid is valid
    assert r.invoice.invoice_number == expected


def test_items(spark):
    rows = run(spark, [
        {"line_items": [{}]},
        {"line_items": [{"description": None}]},
        {"line_items": None},
        {"line_items": {}},
        {"line_items": ""},
        {"line_items": ["a"]},
        {"line_items": [{"description": "x", "quantity": "2", "amount": 3, "zz": 1}]},
    ])
    assert rows[0].valid and rows[0].invoice.line_items[0].asDict() == {
        "description": "", "quantity": None, "unit_price": None, "amount": None}
    assert [r.valid for r in rows[1:6]] == [False] * 5
    assert rows[6].valid and rows[6].invoice.line_items[0].asDict() == {
        "description": "x", "quantity": 2.0, "unit_price": None, "amount": 3.0}


@pytest.mark.parametrize("top", ["[]", "null", '"x"', "3"])
def test_top_level_must_be_object(spark, top):
    df = extract_records(responses(spark, [top]))
    r = df.collect()[0]
    assert r.json_status == "ok" and r.valid is False
    assert all(v is None for k, v in r.invoice.asDict().items() if k != "line_items")


def test_alias_modes(spark):
    recs = [{"vendor_gstin": "A"}, {"vendor_gst": "B"}, {"vendor_gstin": 5}]
    lax = run(spark, recs)
    strict = run(spark, recs, strict_alias=True)
    assert [r.invoice.vendor_gstin for r in lax] == ["A", "B", None]
    assert [r.valid for r in lax] == [True, True, False]
    assert [r.invoice.vendor_gstin for r in strict] == [None, "B", None]
    assert [r.valid for r in strict] == [True, True, True]


def test_invalid_keeps_fitting_fields_and_extras(spark):
    r = run(spark, [{"invoice_number": 104, "vendor_name": "V", "total": 5, "zz": [1]}])[0]
    assert r.valid is False
    assert r.invoice.vendor_name == "V" and r.invoice.total == 5.0 and r.invoice.invoice_number is None
    assert r.extras is not None


def test_unknown_keys_dropped_when_valid(spark):
    r = run(spark, [{"vendor_name": "V", "zz": 1}])[0]
    assert r.valid and r.extras is None and r.invoice.vendor_name == "V"


@pytest.mark.parametrize("text,value", [
    ("\x1c5", "reject"), ("5\x1f", "reject"), (" 7_1", "reject"), ("031_8 ", "reject"), ("7_1", 71.0), ("\u00a05.5\u2003", 5.5),
    ("\t3\n", 3.0), ("1e400", None), ("1" + "0" * 400, None), ("inf", None)])
def test_number_texts(spark, text, value):
    r = run(spark, [{"total": text}])[0]
    assert r.valid is (value != "reject") and r.invoice.total == (None if value == "reject" else value)


# --- library oracle --------------------------------------------------------------

def _oracle_model():
    pydantic = pytest.importorskip("pydantic")
    item_fields = {n: ((str, "") if k == "string" else (Optional[float], None)) for n, k in ITEM_FIELDS}
    Item = pydantic.create_model("Item", **item_fields)
    fields = {}
    for n, k in INVOICE_FIELDS:
        if n == "line_items":
            fields[n] = (List[Item], [])
        elif n in FIELD_ALIASES:
            fields[n] = (Optional[str], pydantic.Field(None, alias=FIELD_ALIASES[n]))
        else:
            fields[n] = (Optional[str] if k == "string" else Optional[float], None)
    return pydantic, pydantic.create_model("Record", **fields)


_scalar = st.one_of(st.none(), st.booleans(), st.integers(-1000, 1000),
                    st.floats(allow_nan=False, allow_infinity=False, width=32),
                    st.sampled_from(["", " 1.5 ", "x", "1e3", "1,2", "2_0", "nan", "-inf", "5."]),
                    st.text(alphabet="0123._eE+- \u00a0\x1c\x1f\t\u2003", max_size=7))
_item = st.one_of(_scalar, st.dictionaries(st.sampled_from(["description", "quantity", "unit_price", "amount", "zz"]),
                                            _scalar, max_size=4))
_record = st.dictionaries(
    st.sampled_from(["vendor_name", "vendor_gst", "invoice_number", "subtotal", "total",
                     "tax_percent", "notes", "currency", "line_items", "zz"]),
    st.one_of(_scalar, st.lists(_item, max_size=3)), max_size=6)


@settings(max_examples=1, deadline=None)
@given(st.lists(_record, min_size=400, max_size=400))
def test_matches_library_model(spark, records):
    pydantic, Model = _oracle_model()
    rows = run(spark, records, strict_alias=True)
    for rec, row in zip(records, rows):
        try:
            m = Model.model_validate(rec)
            expect_valid = True
        except pydantic.ValidationError:
            expect_valid = False
        assert row.valid is expect_valid, rec
        if not expect_valid:
            continue
        got = row.invoice.asDict(recursive=True)
        want = json.loads(m.model_dump_json())
        for k, v in want.items():
            if k == "line_items":
                assert got[k] == v, rec
            elif isinstance(v, float):
                assert got[k] == pytest.approx(v), rec
            else:
                assert got[k] == v, (k, rec)


def test_text_and_variant_readings_agree(spark):
    """Records read from their text equal those cast from the parsed value,
    negative zeros, repeated keys and numbers beyond a decimal among them."""
    item = '{"description": "a\\\\u00e9\\\\n", "quantity": -0.0, "unit_price": 1.10, "amount": null}'
    texts = ['{"total": -0, "subtotal": -0.0, "tax_amount": 0.1, "line_items": [%s, {"amount": 12345678901234567890.5}]}' % item,
             '{"total": -0e0, "subtotal": 1e400, "line_items": [{"amount": -0e0}]}', '{"total": NaN, "subtotal": -Infinity}',
             '{"total": "x", "total": 5, "line_items": [{"amount": "y", "amount": 7}]}', '{"total": NaN, "total": 5, "notes": "1", "notes": null}',
             'see {"total": 1.5, "notes": " \\\\ud83d\\\\ude00 "} there', '```json\n{"total": 2, "vendor_gst": "V"}\n```', '{', '[{"total": 1}]',
             '{"total": 123456789012345678901234567890123456789012, "line_items": [{"description": null}]}', ' {"line_items": []} ', '{"line_items": null}']
    df = responses(spark, texts)

    def rows(x):
        return {r.path: (r.json_status, r.valid, r.n_items, repr(r.invoice)) for r in x.select("path", "json_status", "valid", "n_items", "invoice").collect()}

    by_text = rows(validate_records(repair_responses(df, text="json"), text="json"))
    assert by_text == rows(validate_records(repair_responses(df)))
    assert len(by_text) == len(texts) and "-0.0" not in by_text["f0"][3] and "amount=7.0" in by_text["f3"][3]


def test_plain_records_are_read_without_a_variant_cast(spark):
    """Casting a variant costs several times a typed parse of the text: a
    record of plain numbers takes the parse, and the members of the slow path
    are no columns of their own."""
    plan = extract_records(responses(spark, ["{}"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" in plan and "__ll_v_total" not in plan
