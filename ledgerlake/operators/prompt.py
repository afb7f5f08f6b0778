"""Prompt building (T3-T5): two styles, with an optional per-row currency hint.

Both styles are native string expressions around literals built once on the
driver; the document text is the only per-row part.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import INVOICE_FIELDS, ITEM_FIELDS

INSTRUCTION = (
    "You get the recognised text of one commercial invoice. Return a single JSON object with exactly the keys of "
    "`schema`, and no text around it. Types: every money, rate and quantity key holds a JSON number without "
    "currency signs or thousands marks; the date keys hold ISO 8601 calendar dates; `currency` holds an ISO 4217 code, "
    "where the schema's own value counts unless the text names another. Missing facts: use null, never a guess. "
    "An address that spans several lines becomes one line with a comma at each break. `line_items` repeats the "
    "invoice's table rows in their order and holds no row that the text lacks."
)

# One worked example, own values, in a column layout.
EXAMPLE_INPUT = (
    "HARBOUR PAPER MILLS\n12 Quay Road\nPort Ellery\nGST no. 07HPMIL4410K1Z9\n\n"
    "TAX INVOICE HPM/0931          issued 3 March 2023, payable by 2 April 2023\n"
    "Customer: Lantern Bookshop, 4 Mill Lane, Oakham (GST no. 09LANTB7723Q1Z4)\n\n"
    "Article               Qty      Rate     Value\n"
    "A4 ream, 80 g          30      4.20    126.00\n"
    "Kraft roll              2     37.00     74.00\n"
    "                     Taxable value    200.00\n"
    "                     GST at 12 %       24.00\n"
    "                     Amount due   GBP 224.00\n"
    "Returns within 14 days."
)
EXAMPLE_OUTPUT = {
    "vendor_name": "Harbour Paper Mills", "vendor_address": "12 Quay Road, Port Ellery",
    "vendor_gstin": "07HPMIL4410K1Z9", "invoice_number": "HPM/0931",
    "invoice_date": "2023-03-03", "due_date": "2023-04-02",
    "buyer_name": "Lantern Bookshop", "buyer_address": "4 Mill Lane, Oakham", "buyer_gstin": "09LANTB7723Q1Z4",
    "currency": "GBP", "subtotal": 200.0, "tax_percent": 12.0, "tax_amount": 24.0, "total": 224.0,
    "line_items": [
        {"description": "A4 ream, 80 g", "quantity": 30, "unit_price": 4.2, "amount": 126.0},
        {"description": "Kraft roll", "quantity": 2, "unit_price": 37.0, "amount": 74.0},
    ],
    "notes": "Returns within 14 days.",
}

_HINT_MARK = "\u0000HINT\u0000"


def _schema_template(hint_value) -> dict:
    empty = {"string": "", "double": None}
    out = {n: empty.get(k) for n, k in INVOICE_FIELDS}
    out["currency"] = hint_value
    out["line_items"] = [{n: empty[k] for n, k in ITEM_FIELDS}]
    return out


def hint_value(hint: Column | str | None) -> Column:
    """The currency hint, '' when not given (T5)."""
    if hint is None:
        return F.lit("")
    c = F.lit(hint) if isinstance(hint, str) else hint
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(""))


def _schema_struct(hint: Column) -> Column:
    empty = {"string": F.lit(""), "double": F.lit(None).cast("double")}
    values = {n: empty.get(k) for n, k in INVOICE_FIELDS}
    values["currency"] = hint
    values["line_items"] = F.array(F.struct(*[empty[k].alias(n) for n, k in ITEM_FIELDS]))
    return F.struct(*[c.alias(n) for n, c in values.items()])


def json_prompt(text: Column, hint: Column | str | None = None) -> Column:
    """One JSON object {instruction, schema, examples, text}."""
    examples = F.parse_json(F.lit(json.dumps(
        [{"input": EXAMPLE_INPUT, "output": EXAMPLE_OUTPUT}])))
    payload = F.struct(F.lit(INSTRUCTION).alias("instruction"),
                       _schema_struct(hint_value(hint)).alias("schema"),
                       examples.alias("examples"),
                       text.alias("text"))
    return F.to_json(payload, {"ignoreNullFields": "false"})


def _plain_parts() -> tuple[str, str]:
    template = json.dumps(_schema_template(_HINT_MARK), indent=2)
    head = "\n\n".join([
        "# Task\n" + INSTRUCTION,
        "# Schema\n" + template,
        "# Worked example: text\n" + EXAMPLE_INPUT,
        "# Worked example: answer\n" + json.dumps(EXAMPLE_OUTPUT, indent=2),
        "# Invoice to read\n",
    ])
    before, after = head.split(json.dumps(_HINT_MARK))
    return before, after


PLAIN_BEFORE, PLAIN_AFTER = _plain_parts()


def plain_prompt(text: Column, hint: Column | str | None = None) -> Column:
    """Plain text: schema with the hint in its currency slot, rules, example,
    then the document text (T4)."""
    quoted = F.regexp_replace(F.to_json(F.array(hint_value(hint))), r"^\[|\]$", "")
    return F.concat(F.lit(PLAIN_BEFORE), quoted, F.lit(PLAIN_AFTER), text)
