"""Flat rows of invalid records (F2-F5) against the rules written out in
plain Python, on random records.  Records are made invalid by a numeric
invoice_number, so every other field is read as it stands."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import responses
from ledgerlake.operators import reshape
from ledgerlake.operators.extract import extract_records
from ledgerlake.schema import FLAT_HEADER_ORDER, DOUBLE_HEADER

ITEM_COLS = ["description", "quantity", "unit_price", "amount"]


def fit(name, v):
    if name in DOUBLE_HEADER or name in ("quantity", "unit_price", "amount"):
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    return v if isinstance(v, str) else None


def expected_rows(rec):
    header = {k: fit(k, rec.get(k)) for k in FLAT_HEADER_ORDER}
    items = rec.get("line_items")
    if not isinstance(items, list) or not items:
        return [tuple(header[k] for k in FLAT_HEADER_ORDER) + (None,) * 4]
    rows = []
    for it in items:
        h = dict(header)
        if isinstance(it, dict):
            for k in FLAT_HEADER_ORDER:
                if k in it:
                    h[k] = fit(k, it[k])
            cols = tuple(fit(c, it.get(c)) for c in ITEM_COLS)
        else:
            cols = (None,) * 4
        rows.append(tuple(h[k] for k in FLAT_HEADER_ORDER) + cols)
    return rows


_val = st.one_of(st.none(), st.booleans(), st.integers(-50, 50), st.sampled_from([1.5, -2.25, "x", "", "7"]))
_keys = st.sampled_from(["vendor_name", "currency", "total", "subtotal", "notes", "description",
                         "quantity", "amount", "zz"])
_item = st.one_of(_val, st.dictionaries(_keys, _val, max_size=4))
_rec = st.fixed_dictionaries(
    {"invoice_number": st.integers(1, 99)},
    optional={"vendor_name": _val, "currency": _val, "total": _val, "notes": _val,
              "line_items": st.one_of(_val, st.lists(_item, max_size=4))})


@settings(max_examples=1, deadline=None)
@given(st.lists(_rec, min_size=200, max_size=200))
def test_flat_invalid_records(spark, recs):
    df = extract_records(responses(spark, [json.dumps(r) for r in recs]))
    flat = reshape.flat_table(df, with_line_no=True).collect()
    got = {}
    for r in flat:
        got.setdefault(r.path, []).append((r.line_no, tuple(r[c] for c in FLAT_HEADER_ORDER + ITEM_COLS)))
    for i, rec in enumerate(recs):
        rows = [v for _, v in sorted(got[f"f{i}"], key=lambda x: (x[0] is None, x[0]))]
        assert rows == expected_rows(rec), rec
