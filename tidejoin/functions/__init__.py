"""Column expressions: join predicates, windows, and the hash of the join table."""
