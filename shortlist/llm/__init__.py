"""Training-data operators: scans, extraction, deduplication, filtering, archives and packing.

Nothing outside this folder imports it; its queries and SQL twins are in ``catalog``.
"""
