"""Operators of the ledger engine."""
