"""Canonical invoice record: field names, types and column orders.

The names and orders below are fixed values: they must equal the ones the
extracted tables are expected to carry, so they are spelled out as text.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Invoice header fields in declaration order (line_items sits before notes).
INVOICE_FIELDS = [
    ("vendor_name", "string"),
    ("vendor_address", "string"),
    ("vendor_gstin", "string"),
    ("invoice_number", "string"),
    ("invoice_date", "string"),
    ("due_date", "string"),
    ("buyer_name", "string"),
    ("buyer_address", "string"),
    ("buyer_gstin", "string"),
    ("currency", "string"),
    ("subtotal", "double"),
    ("tax_percent", "double"),
    ("tax_amount", "double"),
    ("total", "double"),
    ("line_items", "items"),
    ("notes", "string"),
]

# Line item fields in declaration order.
ITEM_FIELDS = [
    ("description", "string"),
    ("quantity", "double"),
    ("unit_price", "double"),
    ("amount", "double"),
]

# Input keys of the two tax-id fields (the record reads them under these names).
FIELD_ALIASES = {
    "vendor_gstin": "vendor_gst",
    "buyer_gstin": "buyer_gst",
}

# Column order of the flat table: header, then unknown keys, then item columns.
FLAT_HEADER_ORDER = [
    "vendor_name", "vendor_address", "vendor_gstin",
    "buyer_name", "buyer_address", "buyer_gstin",
    "invoice_number", "invoice_date", "due_date",
    "currency", "subtotal", "tax_percent", "tax_amount", "total", "notes",
]
FLAT_ITEM_ORDER = ["description", "quantity", "unit_price", "amount"]

# Accepted upload extensions.
ALLOWED_EXTENSIONS = ["pdf", "png", "jpg", "jpeg", "tiff"]

# Preview length of the recognised text, in characters.
PREVIEW_CHARS = 20000

# Default rasterisation resolution (dots per inch).
DEFAULT_DPI = 300
# --- end of fixed values ----------------------------------------------------

HEADER_FIELDS = [(n, t) for n, t in INVOICE_FIELDS if n != "line_items"]
STRING_HEADER = [n for n, t in HEADER_FIELDS if t == "string"]
DOUBLE_HEADER = [n for n, t in HEADER_FIELDS if t == "double"]

LINE_ITEM_TYPE = T.StructType(
    [T.StructField(n, T.StringType() if t == "string" else T.DoubleType(), True)
     for n, t in ITEM_FIELDS]
)


def _spark_type(kind: str) -> T.DataType:
    if kind == "string":
        return T.StringType()
    if kind == "double":
        return T.DoubleType()
    return T.ArrayType(LINE_ITEM_TYPE, True)


INVOICE_TYPE = T.StructType(
    [T.StructField(n, _spark_type(t), True) for n, t in INVOICE_FIELDS]
)

FLAT_COLUMNS = FLAT_HEADER_ORDER + ["extras"] + FLAT_ITEM_ORDER

# Schema of the `binaryFile` source.
BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])
