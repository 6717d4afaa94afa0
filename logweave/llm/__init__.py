"""Training-data operators on Spark: quality, deduplication, mixing, tokens, search.

Nothing outside this folder imports it.
"""
