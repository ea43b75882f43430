"""Ledger analytics on Spark: typed ledgers, documents, graphs and event streams as DataFrames."""
