"""Training-data operators (dedup, scoring, scans, packing, archives).

Self-contained: nothing else in the library imports this subpackage.
"""
