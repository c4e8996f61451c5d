"""All queries of the core."""

from __future__ import annotations

from weftline.plans import files, general, sequences

QUERIES = {**general.QUERIES, **sequences.QUERIES, **files.QUERIES}
SQL = {**general.SQL, **sequences.SQL, **files.SQL}
FLAGSHIP = sequences.hits_by_position
