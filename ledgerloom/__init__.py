"""Wallet-ledger analytics and corpus preparation, written as Spark DataFrame programs."""
