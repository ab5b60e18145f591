"""Training-data operators: scoring, encoding, packing, deduplication, classification, fingerprints.

Nothing outside this subpackage imports it.  ``registry`` lists the queries and their SQL.
"""
