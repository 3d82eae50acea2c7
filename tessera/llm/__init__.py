"""Training-data operators: dedup, decontamination, scoring, packing and scans.

Nothing else in the library imports this subpackage.
"""
