"""Training-data operators: cleaning, deduplication, packing, scoring, sharding and search.

Nothing outside this folder imports it; ``queries.py`` holds the registered
queries and ``oracles.py`` their SQL.
"""
