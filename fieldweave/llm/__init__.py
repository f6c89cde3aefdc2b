"""Training-data operators: scans, quality, duplicates, tokens and archives.

Nothing outside this subpackage imports it; its queries are in ``queries.py``.
"""
