"""Training-data operators: extraction, tokenization, search, scoring, deduplication, filtering.

Nothing outside this subpackage imports it; ``queries()`` and ``oracle_sql()`` in ``entry`` are what the driver
contract adds when the subpackage is present.
"""
