"""Whole runs: from inputs to the set of result tables."""
