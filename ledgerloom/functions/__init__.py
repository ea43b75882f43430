"""Part of the ledger engine."""
