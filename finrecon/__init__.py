"""Reconciliation of company financial statements as Spark plans."""
