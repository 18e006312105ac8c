"""Business analytics on Spark: listings, documents, stock ledger, workflow jobs,
integrity checks and reports for a trading company, as DataFrame jobs."""
