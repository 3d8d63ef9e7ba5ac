"""Training-data operators: deduplication, WARC, packing, quality, PII, decontamination.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns DataFrames; ``registry`` holds the queries and their SQL.
"""
