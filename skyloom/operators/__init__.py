"""Catalogue operators: search, scoring, overlap, products."""
