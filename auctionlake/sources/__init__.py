"""Readers for pages, fixed-width files, GeoJSON, CSV and JSON snapshots."""
