"""Plans of the ledger engine."""
