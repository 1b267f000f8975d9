"""Registered queries: each operator bound to the given tables, with its SQL twin."""

from corpusbank.queries import (  # noqa: F401  (registration)
    classification, coverage, drawing, io, items, joins, maintenance, reports, search, segments,
    text,
)
from corpusbank.queries.registry import QUERIES, SQL  # noqa: F401
