"""Training-data operators: mixing, scans, scoring, dedup, packing and binary outputs.

Nothing outside this subpackage imports it. `registry` lists the queries and their SQL.
"""
