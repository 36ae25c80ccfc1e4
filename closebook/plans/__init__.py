"""The derived workload, and the queries over it with their SQL twins."""
