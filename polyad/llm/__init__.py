"""Training-data operators: fingerprints, scans, rules, deduplication, tokens, packing and scoring.

Nothing outside this subpackage imports it.
"""
