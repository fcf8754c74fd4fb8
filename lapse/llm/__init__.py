"""Training-data operators: mixing, sharding, HTML extraction, near-duplicates,
LM scoring, decontamination, substring dedup, PII and language identification.

Nothing else in the library imports this subpackage.
"""
