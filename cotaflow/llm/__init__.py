"""Operators for preparing training data: search, scoring, token counts, duplicates, licences, mixing, encoding."""
