"""Training-data pipeline operators: deduplication, decontamination, scoring, detection, mixing.

Nothing else in the library imports this subpackage.
"""
