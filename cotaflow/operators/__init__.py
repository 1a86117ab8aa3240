"""Reusable DataFrame steps: joins, totals, ordered picks, windows, distributions and reshaping."""
