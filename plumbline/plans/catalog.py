"""All registered queries and their SQL."""

from . import certify, declared, discovery, documents, governance, laws, relations, streams

_PARTS = (discovery, relations, declared, certify, documents, governance, laws, streams)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
