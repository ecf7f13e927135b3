"""Training-data operators: quality, deduplication, packing, sharding, archives.

Nothing outside this subpackage imports it.  ``queries.py`` registers one query per operator.
"""
