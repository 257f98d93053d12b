"""Training-data operators: scoring, token output, scans, deduplication, decontamination and mixing.

Nothing outside this subpackage imports it.
"""
