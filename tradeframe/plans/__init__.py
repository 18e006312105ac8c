"""What runs: listing specs per kind of record, the query catalogue and its SQL checks."""
