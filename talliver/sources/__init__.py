"""Sources of the ledger engine."""
