"""Ledgerline: analytics on catalogs of postings that are collected as complete snapshots, on Spark."""
