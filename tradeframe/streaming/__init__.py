"""Structured Streaming jobs: the ledger, low-stock alerts, running monthly reports."""
