"""All queries of the library with their SQL twins."""

from tidemark.plans import detector_queries, score_queries, sequence_queries, stream_queries

flagship = sequence_queries.flagship
_ALL = sequence_queries.QUERIES | score_queries.QUERIES | detector_queries.QUERIES | stream_queries.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
