"""DataFrame operators: deduplication, ranking, joins, search index, history."""
