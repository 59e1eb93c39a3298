"""Registered queries: each module has QUERIES and the SQL that checks them."""

from termbridge.catalog import pair_queries, resolve_queries, run_queries, text_queries, vector_queries

MODULES = [pair_queries, text_queries, vector_queries, resolve_queries, run_queries]
