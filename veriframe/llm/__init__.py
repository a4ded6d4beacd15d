"""Training-data operators: deduplication, filtering, search, packing and tokenising.

Nothing outside this folder imports it.
"""
