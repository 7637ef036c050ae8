"""Ledger forensics and corpus preparation as Spark DataFrame operators."""
