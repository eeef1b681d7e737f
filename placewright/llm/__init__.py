"""Operators of a training-data pipeline: decontamination, extraction, mixing, search, counts,
near-duplicates, chat formatting, quality, packing and personal data.

Nothing else in the library imports this subpackage.
"""
