"""Training-data operators (n-gram joins, secret scans, dedup, search, ...)."""
