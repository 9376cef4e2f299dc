"""memlattice: verifiable semantic-memory analytics as Spark plans."""
