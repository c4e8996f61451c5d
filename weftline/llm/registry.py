"""All queries of the subpackage."""

from __future__ import annotations

from weftline.llm import key_queries, text_queries

QUERIES = {**key_queries.QUERIES, **text_queries.QUERIES}
SQL = {**key_queries.SQL, **text_queries.SQL}
