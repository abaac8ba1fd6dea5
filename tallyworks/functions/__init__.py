"""Work-ledger engine."""
