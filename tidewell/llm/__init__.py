"""Training-data operators: deduplication, token counts, filters, formatting.

Nothing outside this package imports it. ``queries.py`` holds the thin
``opN_<name>`` queries, the other modules the general operators.
"""
