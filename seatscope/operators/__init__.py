"""Transforms from input tables to result tables."""
