"""Work-ledger analytics on Spark."""
