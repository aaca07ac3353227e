"""Ledger forensics on Spark: DataFrame operators over a UTXO ledger."""
