"""Stored layouts: star store, pass artifacts, manifests."""
