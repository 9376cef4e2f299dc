"""Column-level building blocks; no function here starts a job."""
