"""Structured streaming over the catalog's operators."""
