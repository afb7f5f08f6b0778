"""All registered queries and their reference SQL."""

from __future__ import annotations

from . import document_queries, invoice_queries
from .oracle import ORACLE as _INVOICE_ORACLE

QUERIES = {}
QUERIES.update(invoice_queries.QUERIES)
QUERIES.update(document_queries.QUERIES)

ORACLE = {}
ORACLE.update(_INVOICE_ORACLE)
ORACLE.update(document_queries.oracle())
