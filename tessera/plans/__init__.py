"""Lineage control and the catalogue of named queries with their SQL twins."""
