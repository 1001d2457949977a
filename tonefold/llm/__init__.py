"""Operators for preparing training data: archives, tokens, near-duplicates, quality, privacy, decontamination.

Nothing outside this subpackage imports it. Each module states its method, its parameters and the
defined result for nulls, empty and very long texts, ties, repeated rows and extra columns.
"""
