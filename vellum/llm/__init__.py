"""Training-data operators: tokenisation, deduplication, quality, privacy, scoring and decontamination.

Nothing else in the library imports this subpackage.
"""
